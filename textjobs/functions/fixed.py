"""Word lists, lookup tables and text frames that results depend on."""
from __future__ import annotations

# Labels kept by the allowlist filter.
ALLOWED_CUISINES = [
    "Indian", "North Indian Recipes", "South Indian Recipes", "Bengali Recipes",
    "Maharashtrian Recipes", "Kerala Recipes", "Tamil Nadu", "Karnataka", "Andhra", "Rajasthani",
    "Gujarati Recipes", "Goan Recipes", "Punjabi", "Chettinad", "Kashmiri", "Mangalorean",
    "Indo Chinese", "Parsi Recipes", "Awadhi", "Konkan", "Sindhi", "Oriya Recipes", "Mughlai",
    "Assamese", "Bihari", "Hyderabadi", "North East India Recipes", "Himachal", "Udupi", "Coorg",
    "North Karnataka", "Uttar Pradesh", "Coastal Karnataka", "Malabar", "Lucknowi",
    "South Karnataka", "Malvani", "Nagaland", "Uttarakhand-North Kumaon", "Kongunadu", "Haryana",
    "Jharkhand",
]

# Keywords that tag a label in the profile report.
TAG_KEYWORDS = [
    "indian", "south indian", "north indian", "andhra", "bengali", "gujarati", "punjabi",
    "rajasthani", "kerala", "tamil", "maharashtrian", "mughal", "awadhi", "hyderabadi",
    "karnataka", "goan", "kashmiri", "chettinad", "biryani",
]

# Column order of the merged table, columns dropped, columns kept.
MERGED_COLUMNS = [
    "TranslatedRecipeName", "TranslatedIngredients", "Cleaned-Ingredients", "TotalTimeInMins",
    "PrepTimeInMins", "CookTimeInMins", "Servings", "Cuisine", "Course", "Diet",
    "TranslatedInstructions", "URL", "image-url", "Ingredient-count",
]
KEPT_COLUMNS = [
    "TranslatedRecipeName", "TranslatedIngredients", "TotalTimeInMins", "Servings", "Cuisine",
    "Course", "Diet", "TranslatedInstructions",
]
ENRICHMENT_COLUMNS = ["Diet", "Course", "PrepTimeInMins", "CookTimeInMins", "Servings"]

# System message of every prompt.
SYSTEM_PROMPT = (
    "You are an expert Indian chef. Generate authentic Indian recipes with detailed "
    "ingredients and clear step-by-step cooking instructions."
)

# Regions, diets and courses looked for in a text, in matching order.
REGIONS = [
    "North Indian", "South Indian", "Bengali", "Gujarati", "Maharashtrian", "Rajasthani",
    "Punjabi", "Goan", "Kerala", "Tamil Nadu", "Andhra", "Karnataka", "Mughlai", "Kashmiri",
    "Hyderabadi", "Awadhi", "Chettinad", "Konkan", "Sindhi", "Parsi",
]
DIETS = ["Vegetarian", "Vegan", "Non[- ]Vegetarian", "Non[- ]Veg", "Jain", "Diabetic"]
COURSES = [
    "Main Course", "Side Dish", "Dessert", "Snack", "Breakfast", "Starter", "Soup", "Salad",
    "Bread", "Drink",
]

# Units that may follow a leading quantity.
UNITS = [
    "cup", "tbsp", "tsp", "g", "kg", "ml", "l", "oz", "lb", "clove", "cloves", "inch", "piece",
    "pieces", "pinch", "handful", "bunch", "sprig", "sprigs", "medium", "large", "small",
]

# Placeholders of the request form and the defaults they stand for.
ANY_DIET, ANY_REGION, ANY_TIME = "Any Diet", "Any Region", "Any Time"
DEFAULT_DESCRIPTOR = "Indian"
DEFAULT_ITEMS = "paneer, spinach, tomato"
DEFAULT_TITLE = "Indian Recipe"
DEFAULT_DISH = "Indian Dish"

# The four adaptation presets.
ADAPTATIONS = [
    ("vegan", "make it fully vegan — replace dairy and meat with plant-based alternatives"),
    ("spicier", "make it significantly spicier — add more chilli, pepper, and heat-giving spices"),
    ("quicker", "reduce cooking time to under 20 minutes — simplify steps while keeping the core flavours"),
    ("milder", "reduce spice and heat — make it milder and suitable for sensitive palates"),
]
# The text around an adapted recipe.
ADAPTATION_FRAME = (
    "Here is an existing recipe:\n\n%s\n\nPlease modify it to: %s\n"
    "Keep the same format (**RecipeName**, **Ingredients:**, **Instructions:**) "
    "but adapt the recipe for the requested change."
)

# Chat markers and the two date lines of the system block.
BEGIN_TEXT = "<|begin_of_text|>"
HEADER_OPEN, HEADER_CLOSE, END_TURN = "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"
ASSISTANT_OPENER = "<|start_header_id|>assistant<|end_header_id|>\n\n"
CUTOFF_LINE = "Cutting Knowledge Date: December 2023\n"
DEFAULT_CHAT_DATE = "26 Jul 2024"

# Item categories, in display order.
ITEM_CATEGORIES = {
    "🌶️ Spices & Masalas": [
        "Cumin Seeds", "Turmeric", "Coriander Powder", "Red Chilli Powder", "Garam Masala",
        "Black Pepper", "Cardamom", "Cinnamon", "Cloves", "Bay Leaves", "Mustard Seeds",
        "Fenugreek Seeds", "Kashmiri Chilli", "Asafoetida", "Amchur", "Chaat Masala",
        "Cumin Powder", "Fennel Seeds", "Star Anise", "Nutmeg", "Mace",
    ],
    "🧅 Aromatics": [
        "Onion", "Garlic", "Ginger", "Green Chilli", "Curry Leaves", "Spring Onion", "Shallots",
    ],
    "🍅 Vegetables": [
        "Tomato", "Spinach", "Potato", "Cauliflower", "Peas", "Eggplant", "Okra", "Bitter Gourd",
        "Bottle Gourd", "Drumstick", "Carrot", "Capsicum", "Corn", "Cabbage", "Beans", "Broccoli",
        "Mushroom", "Pumpkin", "Radish", "Beetroot", "Sweet Potato", "Taro Root", "Plantain",
        "Raw Banana",
    ],
    "🫘 Legumes & Lentils": [
        "Chickpeas", "Toor Dal", "Moong Dal", "Chana Dal", "Urad Dal", "Masoor Dal", "Rajma",
        "Black Chickpeas", "Soya Chunks", "Moong Beans", "Moth Beans",
    ],
    "🧀 Dairy": ["Paneer", "Yogurt", "Ghee", "Cream", "Butter", "Milk", "Khoya", "Hung Curd"],
    "🍗 Proteins": ["Chicken", "Mutton", "Fish", "Prawns", "Eggs", "Lamb", "Crab", "Tofu"],
    "🌾 Grains & Flour": [
        "Rice", "Basmati Rice", "Wheat Flour", "Besan", "Semolina", "Poha", "Vermicelli", "Oats",
        "Jowar Flour", "Ragi Flour",
    ],
    "🥜 Nuts & Seeds": [
        "Cashews", "Almonds", "Peanuts", "Sesame Seeds", "Poppy Seeds", "Melon Seeds",
        "Pistachios", "Walnuts",
    ],
    "🌿 Fresh Herbs": [
        "Coriander Leaves", "Mint Leaves", "Curry Leaves", "Fenugreek Leaves", "Basil", "Dill",
    ],
    "🫙 Pantry Staples": [
        "Oil", "Salt", "Sugar", "Tamarind", "Coconut Milk", "Coconut", "Tomato Puree", "Water",
        "Lemon", "Vinegar",
    ],
}
# Colour class of each category, in the same order.
CATEGORY_CLASSES = [
    "spice", "aromatic", "veggie", "legume", "dairy", "protein", "grain", "nut", "herb", "pantry",
]
# Item sets for the seeded choice.
SEED_SETS = [
    ["Spinach", "Paneer", "Tomato", "Garlic", "Cumin Seeds"],
    ["Chicken", "Yogurt", "Ginger", "Garam Masala", "Onion"],
    ["Toor Dal", "Tomato", "Turmeric", "Mustard Seeds", "Curry Leaves"],
    ["Potato", "Peas", "Cumin Seeds", "Coriander Powder", "Green Chilli"],
    ["Chickpeas", "Tomato", "Onion", "Ginger", "Garlic"],
    ["Basmati Rice", "Mutton", "Yogurt", "Cardamom", "Saffron"],
    ["Cauliflower", "Potato", "Cumin Seeds", "Coriander Powder", "Turmeric"],
    ["Prawns", "Coconut Milk", "Curry Leaves", "Mustard Seeds", "Tamarind"],
    ["Moong Dal", "Spinach", "Ghee", "Turmeric", "Asafoetida"],
    ["Paneer", "Capsicum", "Tomato", "Cashews", "Cream"],
]
