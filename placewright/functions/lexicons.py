"""Lookup tables. All values in this module are fixed values: results depend on each of them."""

from __future__ import annotations

# Token -> token of the same meaning.
SYNONYMS = {
    "كافيه": "قهوه", "كافي": "قهوه", "كوفي": "قهوه", "مقهي": "قهوه", "coffee": "قهوه", "cafe": "قهوه", "cafeteria": "قهوه", "مطعم": "مطعم",
    "restaurant": "مطعم", "resturant": "مطعم", "صيدليه": "صيدليه", "pharmacy": "صيدليه", "مستشفي": "مستشفي", "hospital": "مستشفي", "مسجد": "مسجد",
    "جامع": "مسجد", "mosque": "مسجد", "masjid": "مسجد", "سوبرماركت": "بقاله", "بقاله": "بقاله", "supermarket": "بقاله", "grocery": "بقاله",
    "صاله": "نادي", "جيم": "نادي", "gym": "نادي", "fitness": "نادي", "نادي": "نادي", "مول": "مول", "mall": "مول", "بنك": "بنك", "bank": "بنك",
    "فندق": "فندق", "hotel": "فندق", "صالون": "صالون", "salon": "صالون", "حلاق": "صالون", "barber": "صالون",
}

# Arabic letter -> Latin letters.
ROMAN_LETTERS = {
    "ا": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s",
    "ض": "d", "ط": "t", "ظ": "z", "ع": "a", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y",
    "پ": "p", "چ": "ch", "ژ": "zh", "گ": "g", "ة": "h", "ى": "a",
}

# Romanised word -> spelling in place names, applied in this order as whole words ("al" also takes the space after it).
ROMAN_WORDS = [
    ("al", "al"), ("kwfy", "coffee"), ("kafyh", "cafe"), ("kfyh", "cafe"), ("mwl", "mall"), ("rstwrant", "restaurant"), ("mtam", "restaurant"),
    ("fndq", "hotel"), ("mstshfy", "hospital"), ("sydlyh", "pharmacy"), ("bnk", "bank"), ("msjd", "mosque"), ("jam", "mosque"),
    ("swbrmarkt", "supermarket"), ("mrkz", "center"), ("shark", "sharq"),
]

# Fixed values: (tag key, tag value) -> category; keys rank in the order of TAG_KEYS.
TAG_CATEGORIES = {
    ("amenity", "cafe"): "cafe", ("amenity", "fast_food"): "fast_food_restaurant", ("amenity", "restaurant"): "restaurant",
    ("amenity", "pharmacy"): "pharmacy", ("amenity", "bank"): "bank_credit_union", ("amenity", "atm"): "atm", ("amenity", "hospital"): "hospital",
    ("amenity", "clinic"): "medical_clinic", ("amenity", "doctors"): "medical_clinic", ("amenity", "dentist"): "dentist",
    ("amenity", "place_of_worship"): "mosque", ("amenity", "fuel"): "gas_station", ("amenity", "car_wash"): "car_wash",
    ("amenity", "cinema"): "movie_theater", ("amenity", "school"): "school", ("amenity", "university"): "university",
    ("shop", "supermarket"): "grocery_store", ("shop", "convenience"): "convenience_store", ("shop", "bakery"): "bakery",
    ("shop", "clothes"): "clothing_store", ("shop", "jewelry"): "jewelry_store", ("shop", "mobile_phone"): "mobile_phone_store",
    ("shop", "optician"): "eyewear_and_optician", ("shop", "hairdresser"): "hair_salon", ("shop", "car_repair"): "auto_repair_shop",
    ("shop", "mall"): "shopping_center", ("shop", "perfumery"): "perfume_store", ("tourism", "hotel"): "hotel", ("tourism", "museum"): "museum",
    ("leisure", "fitness_centre"): "gym", ("office", "government"): "government_office",
}
TAG_KEYS = ["amenity", "shop", "tourism", "leisure", "office"]

# Normalised brand -> category; of several prefixes the first in this order counts.
BRAND_CATEGORIES = {
    "krispy kreme": "donuts", "كرسبي كريم": "donuts", "dunkin": "donuts", "دانكن دونتس": "donuts", "kfc": "fast_food_restaurant",
    "كنتاكي": "fast_food_restaurant", "hardees": "fast_food_restaurant", "هارديز": "fast_food_restaurant", "mcdonalds": "fast_food_restaurant",
    "ماكدونالدز": "fast_food_restaurant", "burger king": "fast_food_restaurant", "برجر كنج": "fast_food_restaurant", "subway": "fast_food_restaurant",
    "صب واي": "fast_food_restaurant", "albaik": "fast_food_restaurant", "البيك": "fast_food_restaurant", "kudu": "fast_food_restaurant",
    "كودو": "fast_food_restaurant", "herfy": "fast_food_restaurant", "هرفي": "fast_food_restaurant", "papa johns": "pizza_restaurant",
    "pizza hut": "pizza_restaurant", "بيتزا هت": "pizza_restaurant", "دومينوز": "pizza_restaurant", "shawarmer": "fast_food_restaurant",
    "شاورمر": "fast_food_restaurant", "starbucks": "coffee_shop", "ستاربكس": "coffee_shop", "costa coffee": "coffee_shop", "كوستا": "coffee_shop",
    "caribou coffee": "coffee_shop", "دوز": "coffee_shop", "tim hortons": "coffee_shop", "تيم هورتنز": "coffee_shop", "barns": "coffee_shop",
    "بارنز": "coffee_shop", "%arabica": "coffee_shop", "ارابيكا": "coffee_shop", "nahdi": "pharmacy", "النهدي": "pharmacy", "صيدليه النهدي": "pharmacy",
    "aldawaa": "pharmacy", "الدواء": "pharmacy", "united pharmacy": "pharmacy", "المتحده": "pharmacy", "panda": "grocery_store",
    "بنده": "grocery_store", "danube": "grocery_store", "الدانوب": "grocery_store", "tamimi markets": "grocery_store", "التميمي": "grocery_store",
    "carrefour": "grocery_store", "كارفور": "grocery_store", "lulu hypermarket": "grocery_store", "لولو": "grocery_store", "othaim": "grocery_store",
    "العثيم": "grocery_store", "jarir bookstore": "book_store", "مكتبه جرير": "book_store", "extra": "electronics_store", "اكسترا": "electronics_store",
    "ikea": "furniture_store", "ايكيا": "furniture_store", "al rajhi bank": "bank_credit_union", "مصرف الراجحي": "bank_credit_union",
    "الراجحي": "bank_credit_union", "الاهلي": "bank_credit_union", "بنك الجزيره": "bank_credit_union", "صراف بنك الجزيره": "atm",
    "riyad bank": "bank_credit_union", "بنك الرياض": "bank_credit_union", "stc": "mobile_phone_store", "اس تي سي": "mobile_phone_store",
    "mobily": "mobile_phone_store", "موبايلي": "mobile_phone_store", "zain": "mobile_phone_store", "زين": "mobile_phone_store",
}

# Category -> worth of a website to that trade.
CATEGORY_FIT = {
    "restaurant": 1.0, "cafe": 0.95, "coffee_shop": 0.95, "bakery": 0.9, "fast_food_restaurant": 0.7, "donuts": 0.7, "pizza_restaurant": 0.85,
    "seafood_restaurant": 1.0, "mediterranean_restaurant": 1.0, "indian_restaurant": 1.0, "breakfast_and_brunch_restaurant": 1.0, "hotel": 0.9,
    "hookah_bar": 0.8, "beauty_salon": 1.0, "hair_salon": 1.0, "spa": 1.0, "nail_salon": 1.0, "barber": 1.0, "medical_clinic": 1.0, "dentist": 1.0,
    "physiotherapist": 1.0, "veterinarian": 1.0, "gym": 0.95, "fitness_center": 0.95, "photography_store_and_services": 1.0,
    "party_and_event_planning": 1.0, "wedding_planning": 1.0, "travel_services": 0.95, "driving_school": 0.9, "lawyer": 1.0, "accounting": 1.0,
    "real_estate_agent": 1.0, "insurance_agency": 0.9, "marketing_agency": 0.8, "media_agency": 0.8, "professional_services": 0.9, "consulting": 0.9,
    "education": 0.9, "school": 0.8, "training_centre": 0.9, "furniture_store": 1.0, "jewelry_store": 1.0, "clothing_store": 0.9, "perfume_store": 0.9,
    "flowers_and_gifts_shop": 1.0, "car_dealer": 0.85, "automotive_repair": 0.9, "auto_repair_shop": 0.9, "electronics_store": 0.85, "art_gallery": 1.0,
    "book_store": 0.8, "optician": 0.85, "eyewear_and_optician": 0.85, "cosmetic_and_beauty_supplies": 0.85, "shopping": 0.7, "shopping_center": 0.5,
    "grocery_store": 0.35, "convenience_store": 0.2, "pharmacy": 0.3, "gas_station": 0.15, "car_wash": 0.4, "laundry": 0.5, "atm": 0.0,
    "bank_credit_union": 0.0, "mosque": 0.0, "government_office": 0.0, "embassy": 0.0, "hospital": 0.1, "university": 0.1, "post_office": 0.0,
    "police": 0.0, "bus_stop": 0.0, "parking": 0.0, "public_restroom": 0.0, "school_district": 0.0,
}
DEFAULT_FIT = 0.55

# Fixed values: (part of a normalised Arabic category, worth); the first in this order counts.
ARABIC_FIT = [
    ("صراف", 0.0), ("بنك", 0.0), ("مسجد", 0.0), ("جامع", 0.0), ("حكوم", 0.0), ("سفاره", 0.0), ("شرطه", 0.0), ("بريد", 0.0), ("محطه وقود", 0.15),
    ("محطة بنزين", 0.15), ("صيدل", 0.3), ("بقاله", 0.35), ("سوبرماركت", 0.35), ("تموينات", 0.3), ("مغسل", 0.5), ("غسيل سيارات", 0.4), ("صالون", 1.0),
    ("حلاق", 1.0), ("تجميل", 1.0), ("سبا", 1.0), ("عياده", 1.0), ("اسنان", 1.0), ("مستوصف", 1.0), ("طبي", 0.95), ("مركز صحي", 0.95), ("بيطري", 1.0),
    ("علاج طبيعي", 1.0), ("مستشفي", 0.1), ("رياض", 0.95), ("لياقه", 0.95), ("نادي", 0.9), ("حفلات", 1.0), ("زفاف", 1.0), ("مناسبات", 1.0), ("كوش", 1.0),
    ("حدث", 1.0), ("احداث", 1.0), ("تنظيم", 0.95), ("مدرب", 0.9), ("تصوير", 1.0), ("مصور", 1.0), ("سياح", 0.95), ("سفر", 0.95), ("مطعم", 1.0),
    ("مقهي", 0.95), ("كافيه", 0.95), ("كوفي", 0.95), ("مخبز", 0.9), ("حلويات", 0.9), ("عصير", 0.7), ("بوفيه", 0.8), ("فندق", 0.9), ("شقق مفروشه", 0.9),
    ("استراحه", 0.85), ("مفروشات", 1.0), ("اثاث", 1.0), ("مجوهرات", 1.0), ("ذهب", 1.0), ("زهور", 1.0), ("ورد", 1.0), ("هدايا", 1.0), ("عطور", 0.9),
    ("ملابس", 0.9), ("ازياء", 0.9), ("عبايات", 0.95), ("خياط", 0.9), ("سيارات", 0.9), ("ورشه", 0.9), ("قطع غيار", 0.85), ("الكترون", 0.85),
    ("جوال", 0.85), ("كمبيوتر", 0.85), ("نظارات", 0.85), ("بصريات", 0.85), ("معرض", 0.9), ("محام", 1.0), ("محاسب", 1.0), ("عقار", 1.0), ("تامين", 0.9),
    ("استشار", 0.9), ("تسويق", 0.8), ("دعايه", 0.8), ("مقاول", 0.85), ("تدريب", 0.9), ("معهد", 0.9), ("مدرسه", 0.8), ("حضانه", 0.9), ("متجر", 0.85),
    ("محل", 0.85), ("مركز تسوق", 0.5), ("سوق", 0.5),
]

# Hotel groups, found anywhere in a normalised name.
CHAIN_MARKERS = [
    "rotana", "marriott", "hilton", "accor", "novotel", "ibis", "radisson", "movenpick", "fairmont", "kempinski", "sheraton", "holiday inn", "ritz",
    "courtyard", "four seasons", "intercontinental", "crowne plaza", "hyatt", "centro", "braira", "boudl", "swissotel", "voco", "millennium",
]
