"""Dictionaries of the domain. All of them are fixed values that results depend on."""

from __future__ import annotations

from typing import NamedTuple


class Spec(NamedTuple):
    id: str
    label: str
    unit: str | None
    direction: str  # higher, lower, exact; boolean for specs that are present or absent
    matchers: tuple[str, ...]  # of a boolean spec: (present, absent)
    needs: tuple[str, ...] = ()  # small letters or signs one of which a text holds wherever a matcher does; () if unknown: it is always tried


# Numeric specifications with the patterns that read them.
SPECS = (
    Spec("cfm", "CFM", "CFM", "higher", (r"(\d{2,4})\s*\+?\s*cfm\b",), ("cfm",)),
    Spec("mph", "MPH", "MPH", "higher", (r"(\d{2,3})\s*\+?\s*mph\b",), ("mph",)),
    Spec("psi", "PSI", "PSI", "higher", (r"(\d{3,4})\s*\+?\s*psi\b",), ("psi",)),
    Spec("gpm", "GPM", "GPM", "higher", (r"(\d(?:\.\d+)?)\s*\+?\s*gpm\b",), ("gpm",)),
    Spec("runtimeMin", "Runtime", "min", "higher", (
        r"(\d{1,3})\s*\+?\s*min(?:ute)?s?\s*(?:of\s*)?(?:runtime|run\s*time|run-time|per\s*charge|on\s*a\s*charge|battery\s*life)",
        r"(?:runtime|run\s*time|run-time|battery\s*life)\b[^.\d]{0,14}(\d{1,3})\s*\+?\s*min(?:ute)?s?\b"), ("min",)),
    Spec("suctionAirwatts", "Suction", "AW", "higher", (r"(\d{2,3})\s*\+?\s*(?:aw|air\s*watts?)\b",), ("aw", "air")),
    Spec("weightLb", "Weight", "lb", "lower", (r"(\d{1,3}(?:\.\d+)?)\s*(?:lbs?|pounds?)\b",), ("lb", "pound")),
    Spec("noiseDb", "Noise", "dB", "lower", (r"(\d{2,3})\s*\+?\s*(?:db|dba|decibels?)\b",), ("db", "decibel")),
    Spec("capacityL", "Capacity", "L", "higher", (
        r"(\d{1,3}(?:\.\d+)?)\s*(?:liters?|litres?)\b",
        r"(?:capacity|tank|bin|dust\s*bin)\b[^.\d]{0,12}(\d{1,3}(?:\.\d+)?)\s*(?:l|liters?|litres?)\b"), ("liter", "litre", "capacity", "tank", "bin")),
    Spec("capacityCups", "Cup capacity", "cups", "higher", (r"(\d{1,2})\s*-?\s*cups?\b",), ("cup",)),
    Spec("btu", "BTU", "BTU", "higher", (r"(\d[\d,]{2,6})\s*\+?\s*btus?\b",), ("btu",)),
    Spec("cookingAreaSqIn", "Cooking area", "sq in", "higher", (r"(\d{3,4})\s*(?:sq\.?\s*in(?:ches)?|square\s*inch(?:es)?)\b",), ("sq",)),
    Spec("burners", "Burners", "burners", "higher", (r"(\d{1,2})\s*-?\s*burners?\b",), ("burner",)),
    Spec("wattage", "Wattage", "W", "higher", (r"(\d[\d,]{2,5})\s*\+?\s*(?:w|watt|watts)\b", r"(\d[\d,]{2,5})\s*-?\s*watt\b"), ("w",)),
    Spec("energyCapacityWh", "Energy capacity", "Wh", "higher", (
        r"(\d[\d,]{2,5})\s*\+?\s*(?:wh|watt[- ]?hours?)\b", r"(?:capacity|energy)\b[^.\d]{0,16}(\d[\d,]{2,5})\s*(?:wh|watt[- ]?hours?)\b"), ("wh", "watt")),
    Spec("runningWattage", "Running wattage", "W", "higher", (
        r"(\d[\d,]{2,5})\s*\+?\s*(?:running|rated|continuous)\s*(?:w|watt|watts)\b",
        r"(?:running|rated|continuous)(?:\s+(?:output|power))?\b[^.\d]{0,16}(\d[\d,]{2,5})\s*(?:w|watt|watts)\b",
        r"\d[\d,]{2,5}\s*(?:w|watt|watts)\s*\/\s*(\d[\d,]{2,5})\s*(?:w|watt|watts)\b"), ("running", "rated", "continuous", "/")),
    Spec("sliceCapacity", "Slice capacity", "slices", "higher", (r"(\d{1,2})\s*-?\s*slice\b",), ("slice",)),
    Spec("functionCount", "Cooking functions", "functions", "higher", (
        r"(\d{1,2})\s*-?\s*in\s*-?\s*1\b", r"(\d{1,2})\s+(?:cooking\s*)?functions?\b", r"(\d{1,2})\s+(?:preset|presets|settings)\b"), ("1", "function", "preset", "settings")),
    Spec("capacityQt", "Capacity", "qt", "higher", (
        r"(\d{1,3}(?:\.\d+)?)\s*(?:qt|quart|quarts)\b", r"(?:capacity)\b[^.\d]{0,12}(\d{1,3}(?:\.\d+)?)\s*(?:qt|quart|quarts)\b"), ("qt", "quart")),
    Spec("capacityGal", "Capacity", "gal", "higher", (
        r"(\d{1,3}(?:\.\d+)?)\s*-?\s*(?:gal|gallon|gallons)\b", r"(?:capacity|tank)\b[^.\d]{0,12}(\d{1,3}(?:\.\d+)?)\s*(?:gal|gallon|gallons)\b"), ("gal",)),
    Spec("capacityPint", "Capacity", "pint", "exact", (r"(\d{1,3}(?:\.\d+)?)\s*-?\s*pints?\b", r"(?:capacity)\b[^.\d]{0,12}(\d{1,3}(?:\.\d+)?)\s*pints?\b"), ("pint",)),
    Spec("temperatureF", "Max temperature", "F", "higher", (
        r"(\d{3})\s*(?:°\s*)?f\b", r"(?:up\s*to|max(?:imum)?|temperature)\b[^.\d]{0,18}(\d{3})\s*(?:degrees?|°)?\s*(?:f|fahrenheit)?\b"), ("f", "up", "max", "temperature")),
    Spec("screenSizeIn", "Screen size", "in", "higher", (
        r'(\d{2,3}(?:\.\d+)?)\s*(?:(?:in\.?|inch(?:es)?)\b|["”](?=\W|$))', r"(\d{2,3}(?:\.\d+)?)\s*-\s*inch\b"), ("in", '"', "”")),
    Spec("refreshRateHz", "Refresh rate", "Hz", "higher", (r"(\d{2,3})\s*\+?\s*hz\b",), ("hz",)),
    Spec("displayResolutionHeightPx", "Display resolution", "p", "higher", (r"(\d{3,4})\s*p\b", r"\b\d{3,5}\s*[x×]\s*(\d{3,4})\b"), ("p", "x", "×")),
    Spec("storageGb", "Storage", "GB", "higher", (
        r"(\d{2,5})\s*\+?\s*gb\s*(?:ssd|storage|drive)\b", r"(?:storage|ssd|solid\s*state\s*drive)\b[^.\d]{0,18}(\d{2,5})\s*\+?\s*gb\b"), ("gb",)),
    Spec("memoryGb", "Memory", "GB RAM", "higher", (r"(\d{1,3})\s*\+?\s*gb\s*(?:ram|memory)\b",), ("gb",)),
    Spec("batteryIncluded", "Battery included", None, "boolean", (
        r"\b(?:batter(?:y|ies)\s+(?:and\s+charger\s+)?included|includes?\s+(?:\(\d+\)\s+)?(?:(?:a|one|two|three|four|\d+)\s+)?(?:\d+(?:\.\d+)?\s*(?:ah|v)\s+)?(?:lithium(?:-ion)?\s+)?batter(?:y|ies)|(?:with|w\/)\s+(?:\(\d+\)\s+)?(?:(?:a|one|two|three|four|\d+)\s+)?(?:\d+(?:\.\d+)?\s*(?:ah|v)\s+)?(?:lithium(?:-ion)?\s+)?batter(?:y|ies)|\bkit\b.{0,45}\bbatter(?:y|ies)|batter(?:y|ies)\s+(?:and\s+charger\s+)?kit|comes?\s+with\s+(?:a\s+)?battery)\b",
        r"\b(?:bare\s*tool|tool[\s-]?only|without\s+(?:a\s+)?battery|no\s+battery|batter(?:y|ies)\s+not\s+included|sold\s+as\s+(?:a\s+)?bare\s*tool)\b"), ("batter", "tool")),
    Spec("twoBatteriesIncluded", "Two batteries included", None, "boolean", (
        r"\b(?:(?:two|2|\(2\))\s+(?:(?:\d+(?:\.\d+)?)\s*(?:ah|v)\s+)?batteries|dual[\s-]?battery\s+kit)\b",
        r"\b(?:(?:one|single|1|\(1\))\s+(?:(?:\d+(?:\.\d+)?)\s*(?:ah|v)\s+)?battery|\d+(?:\.\d+)?\s*ah\s+battery\b|bare\s*tool|tool[\s-]?only)\b"), ("batter", "tool")),
)

# Words around an amount that say how it binds.
MIN_WORDS = r"(?:at least|minimum|\bmin\b|no less than|over|more than|greater than|above|starting at)"
MAX_WORDS = r"(?:under|less than|below|at most|max(?:imum)?|no more than|up to|within)"
EXACT_WORDS = r"(?:exactly|equal to|equals|precisely)"
HARD_WORDS = r"(?:must|need|needs|required|require|requires|has to|have to|\bonly\b|at least|no less than|under|less than|below|at most|no more than|maximum|minimum)"

# Brands and their aliases.
BRANDS = (
    ("Nike", ("nike", "nike air", "nike zoom")), ("Nike", ("air jordan", "jordan brand", "jordan")), ("Adidas", ("adidas", "adidas performance", "adizero")),
    ("New Balance", ("new balance", "newbalance", "nb")), ("ASICS", ("asics",)), ("Brooks", ("brooks",)), ("Hoka", ("hoka", "hoka one one")), ("Puma", ("puma",)),
    ("Reebok", ("reebok",)), ("Saucony", ("saucony",)), ("Skechers", ("skechers",)), ("Under Armour", ("under armour", "underarmour")), ("Converse", ("converse",)),
    ("Vans", ("vans",)), ("Apple", ("apple",)), ("Samsung", ("samsung",)), ("LG", ("lg",)), ("Sony", ("sony",)), ("Bose", ("bose",)), ("Dell", ("dell",)),
    ("HP", ("hp", "hewlett packard", "hewlett-packard")), ("Lenovo", ("lenovo",)), ("GE", ("ge", "ge appliances")), ("Whirlpool", ("whirlpool",)),
    ("KitchenAid", ("kitchenaid", "kitchen aid")), ("Bosch", ("bosch",)), ("Dyson", ("dyson",)), ("Shark", ("shark",)), ("Bissell", ("bissell",)),
    ("Technivorm", ("technivorm", "moccamaster", "technivorm moccamaster")),
    ("DeWalt", ("dewalt", "de walt", "20v max", "20 volt max", "atomic 20v", "atomic 20 volt", "flexvolt")),
    ("Milwaukee", ("milwaukee", "m12 fuel", "m18 fuel", "m12 redlithium", "m18 redlithium")), ("Makita", ("makita",)), ("Ryobi", ("ryobi",)), ("Amazon Basics", ("amazon basics",)),
)

# Where "hp" is horsepower.
HORSEPOWER = (
    r"\bhorsepower\s*\(\s*hp\s*\)", r"\b\d+(?:\.\d+)?\s*(?:peak\s+)?hp\b", r"\b(?:peak|max(?:imum)?|rated)\s+hp\b",
    r"\b(?:motor|engine|pump|compressor|suction)\s+(?:rated\s+)?hp\b", r"\bhp\s+(?:motor|engine|pump|compressor|suction|rating)\b",
)

# Colours and materials, most of them single words.
COLORS = ("beige", "black", "blue", "brown", "charcoal", "cream", "gray", "grey", "green", "ivory", "navy", "red", "stainless steel", "tan", "taupe", "white")
MATERIALS = ("aluminum", "solid wood", "hardwood", "engineered wood", "fabric", "leather", "linen", "mdf", "metal", "microfiber", "particleboard", "performance fabric", "plastic", "polyester", "steel", "upholstered", "upholstery", "velvet", "wood")

# Category groups in order of precedence, and their terms.
CATEGORIES = (
    ("appliances", ("vacuum", "washer", "dryer", "refrigerator", "fridge", "microwave", "dishwasher", "air fryer", "oven", "range")),
    ("automotive", ("car", "truck", "auto", "tire", "battery", "jump starter", "dash cam")),
    ("baby", ("stroller", "crib", "car seat", "diaper", "baby monitor", "high chair")),
    ("beauty", ("makeup", "skincare", "hair dryer", "curling iron", "shaver", "serum")),
    ("clothing", ("shirt", "jacket", "pants", "jeans", "dress", "hoodie", "coat")),
    ("electronics", ("monitor", "laptop", "tv", "television", "headphones", "keyboard", "mouse", "speaker", "tablet")),
    ("furniture", ("couch", "sofa", "sleeper sofa", "pull out couch", "loveseat", "sectional", "chair", "desk", "dresser", "mattress")),
    ("home_improvement", ("paint", "flooring", "faucet", "toilet", "vanity", "lighting", "ceiling fan")),
    ("outdoor", ("baseball glove", "baseball mitt", "bike", "cooler", "fishing rod", "generator", "golf club", "grill", "lawn mower", "patio", "sporting goods", "tent", "backpack")),
    ("pet", ("dog food", "cat food", "dog bed", "crate", "leash", "litter", "pet")),
    ("shoes", ("shoes", "sneakers", "footwear", "basketball shoes", "running shoes", "walking shoes", "boots", "sandals")),
    ("tools", ("drill", "saw", "socket set", "impact wrench", "sander", "tool", "wrench", "driver")),
)

# What a premium may cost over a budget.
PREMIUM_ALLOWANCE = {"appliances": 1200, "automotive": 700, "baby": 500, "beauty": 300, "clothing": 300, "electronics": 700, "furniture": 1000, "general": 500, "home_improvement": 800, "outdoor": 800, "pet": 400, "shoes": 300, "tools": 600}
PREMIUM_MULTIPLIER = {"appliances": 1.75, "electronics": 1.8, "furniture": 1.8, "general": 2.0, "tools": 1.8}

# Bed sizes, the most specific first, and words that make a size a bed's.
BED_SIZES = (
    ("california king", ("california king", "cal king", "ca king", "cal-king", "calking")), ("split king", ("split king",)), ("twin xl", ("twin xl", "twin extra long")),
    ("full xl", ("full xl",)), ("twin", ("twin",)), ("full", ("full",)), ("queen", ("queen",)), ("king", ("king",)),
)
BED_CONTEXT = r"\b(?:mattress|bedding|bedroom|bed frame|platform bed|bunk bed|headboard|sheets?|comforter|duvet|bedspread|box spring|sleeper)\b"

# Sites that review or discuss, their host labels and path words; words that say nothing in a search.
NON_PRODUCT_DOMAINS = (
    "nytimes.com", "wirecutter.com", "rtings.com", "consumerreports.org", "pcmag.com", "cnet.com", "tomsguide.com", "techradar.com", "wired.com", "theverge.com", "seriouseats.com",
    "americastestkitchen.com", "goodhousekeeping.com", "outdoorgearlab.com", "thespruce.com", "thespruceeats.com", "popularmechanics.com", "gearpatrol.com", "reviewed.com", "bhg.com",
    "forbes.com", "businessinsider.com", "nymag.com", "thestrategist.com", "engadget.com", "editorialist.com", "digitaltrends.com", "soundguys.com", "housebeautiful.com",
    "familyhandyman.com", "bobvila.com", "reddit.com", "youtube.com", "quora.com",
)
NON_PRODUCT_LABELS = ("community", "docs", "documentation", "help", "knowledgebase", "manual", "manuals", "support")
NON_PRODUCT_PATH = r"(?i)(?:^|[-_])(?:community|docs|documentation|downloads?|help(?:desk)?(?:[-_]knowledge)?|knowledge-?base|manuals?|support)(?:[-_]|$)"
VAGUE_WORDS = ("best", "cheap", "good", "great", "anything", "item", "items", "product", "products", "stuff", "thing", "things")

# shops' domains, and further words that name a source or a shop.
RETAILER_DOMAINS = (
    "amazon.com", "walmart.com", "target.com", "bestbuy.com", "homedepot.com", "lowes.com", "costco.com", "samsclub.com", "wayfair.com", "chewy.com", "rei.com", "newegg.com",
    "acehardware.com", "overstock.com", "qvc.com", "bjs.com", "menards.com", "tractorsupply.com", "petco.com", "petsmart.com",
)
SOURCE_WORDS = ("consumer", "reports", "good", "housekeeping", "toms", "guide", "test", "kitchen", "spruce", "gear", "patrol", "popular", "mechanics", "business", "insider", "strategist", "digital", "trends", "ebay", "marketplace", "retailer")
#: Keys of sources and shops: their domains without the ending, and the words.
SOURCE_NAMES = tuple(dict.fromkeys([d.rpartition(".")[0] for d in (*NON_PRODUCT_DOMAINS, *RETAILER_DOMAINS)] + list(SOURCE_WORDS)))

# Categories of selectable features by their other names; a category is also its own name.
CATEGORY_ALIASES = {
    "4k monitor": "monitor", "bookshelf": "bookcase", "fridge": "refrigerator", "loveseat": "couch", "pull out couch": "sleeper sofa", "pull out sofa": "sleeper sofa", "pullout couch": "sleeper sofa", "pullout sofa": "sleeper sofa",
    "shelving unit": "shelves", "sleeper couch": "sleeper sofa", "sleeper loveseat": "sleeper sofa", "sofa": "couch", "sofa bed": "sleeper sofa", "television": "tv", "washing machine": "washer", "wine refrigerator": "wine fridge",
}
CATEGORY_NAMES = (
    "air conditioner", "air purifier", "baseball glove", "bed frame", "blender", "bookcase", "camera", "car seat", "carpet cleaner", "cat tree", "chair", "coffee maker", "couch", "cookware", "cookware set", "crib",
    "dehumidifier", "desk", "dishwasher", "dog bed", "dog crate", "dresser", "drill", "dryer", "espresso machine", "freezer", "generator", "grill", "headphones", "impact driver", "keyboard", "knife set", "ladder", "laptop",
    "lawn mower", "leaf blower", "mattress", "microwave", "mini fridge", "monitor", "mouse", "nightstand", "office chair", "oven", "patio chair", "patio table", "printer", "projector", "recliner", "refrigerator", "router", "saw",
    "sectional", "shelves", "shoe rack", "shop vac", "sleeper sofa", "snow blower", "soundbar", "speaker", "stroller", "tablet", "tent", "toaster oven", "tool chest", "tv", "tv stand", "vacuum", "vanity chair", "washer",
    "water filter", "wine fridge",
)

# Colours that a search for a category leaves out, and what else it does.
SEARCH_COLORS = ("beige", "black", "blue", "brown", "charcoal", "cream", "gray", "grey", "green", "ivory", "navy", "red", "tan", "taupe", "white")
SEARCH_NOISE = (
    r"\b(?:under|less than|below|no bigger than|no larger than|no deeper than|no taller than|at most|max|maximum)\s*\d+(?:\.\d+)?\s*(?:inches|inch|in\.?|\")\s*(?:wide|width|deep|depth|high|height|tall)?\b",
    r"\b(?:at least|min|minimum)\s*\d+(?:\.\d+)?\s*(?:inches|inch|in\.?|\")\s*(?:wide|width|deep|depth|high|height|tall)?\b",
    r"\b(?:under|less than|below|no more than|at most|max|maximum)\s*\$?\s*[\d,]+(?:\.\d+)?\b",
    r"\b(?:" + "|".join(SEARCH_COLORS) + r")\b",
    r"\b(?:left|right)[\s-]?(?:hand|arm)?[\s-]?facing\b|\b[lr]af\b",
)
SEARCH_PRAISE = (r"\b(?:best|top rated|recommended|sale|deals?)\b", r"\b(?:for sale|buy online)\b")
