"""Dish types, menu sections and what counts as a meal, by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import any_indexed, first_indexed, matches

# Dish types in order; the last holds for names only.
DISH_RULES = [
    ("burger", r"\b(cheese)?burgers?\b|\bpatty melt\b|\bsmash ?burger\b"),
    ("taco", r"\btacos?\b"),
    ("fajita", r"\bfajitas?\b"),
    ("pizza", r"\bpizzas?\b|\bflatbreads?\b|\bcalzone\b"),
    ("pasta", r"\b(pasta|spaghetti|fettuccine|linguine|rigatoni|penne|lasagna|alfredo|carbonara|bolognese|mac (and|&) cheese|noodles?)\b"),
    ("burrito", r"\bburritos?\b|\bchimichangas?\b"),
    ("wrap", r"\bwraps?\b"),
    ("parmigiana", r"\b(chicken|veal|eggplant|shrimp) parm(igiana|esan)?\b|\bparmigiana\b"),
    ("sandwich", r"\bsandwich(es)?\b|\bsubs?\b|\bclub\b|\bpanini\b|\bhoagie\b|\bmelt\b|\bblt\b|\btorta\b|\bcheesesteak\b|\bbanh mi\b"),
    ("salad_with_protein", r"\bsalads?\b"),
    ("bowl", r"\bbowls?\b|\bpoke\b"),
    ("soup", r"\bsoups?\b|\bchili\b(?!\s*(?:glaze|oil|crisp|crunch|sauce|paste|flake|caramel|lime|garlic|aioli|mayo|butter|jam))|\bstew\b|\bramen\b|\bpho\b|\bchowder\b"),
    ("sushi", r"\b(sushi|nigiri|sashimi|temaki|uramaki|hosomaki|omakase|hand roll)\b"),
    ("sushi", r"\b(tuna|salmon|ahi|yellowtail|hamachi|crab|california|dragon|rainbow|eel|unagi|tempura|tobiko)\b[\w '&-]*\broll\b"),
]
# Fixed values.
NAME_RULE = ("plate", r"\b(plates?|platters?|entr[ée]e|combo|halibut|salmon|sea ?bass|branzino|cod|seabass|cioppino|filet|rib[- ]?eye|ny strip|new york|sirloin|strip|tomahawk|porterhouse|t[- ]?bone|steak|ribs?|pork|chicken|katsu|piccata)\b")

# Dish types that a section stands for.
SECTION_TYPES = [
    ("bowl", r"^(bowls?|rice bowls?|grain bowls?|poke bowls?)$"),
    ("salad_with_protein", r"^salads?$"),
    ("sandwich", r"^(sandwiches|handhelds?|subs?)$"),
    ("burger", r"^(burgers?|smash burgers?)$"),
    ("wrap", r"^wraps?$"),
    ("burrito", r"^burritos?$"),
    ("taco", r"^tacos?$"),
    ("pasta", r"^pastas?$"),
    ("pizza", r"^pizzas?$"),
    ("sushi", r"^(sushi|nigiri|sashimi|rolls?|hand rolls?|maki)$"),
    ("plate", r"^(plates?|protein plates?|platters?|steaks?)$"),
    ("soup", r"^soups?$"),
]

# Sections that are out, with the reason, in order.
EXCLUDED_SECTIONS = [
    ("small plates section", r"\bsmall plates\b"),
    ("side salads section", r"\bside salads?\b"),
    ("drinks section", r"\b(drinks|beverages|soft drinks|sodas?|juices?|coffee|tea|smoothies)\b"),
    ("alcohol section", r"\b(cocktails?|beer|wine|spirits|bar menu|draft list|happy hour)\b"),
    ("dessert section", r"\b(desserts?|sweets|pastries)\b"),
    ("sides section", r"\b(sides?|side dishes|a la carte)\b"),
    ("appetizers section", r"\b(appetizers?|apps|starters|shareables?|snacks)\b"),
    ("kids section", r"\b(kids?|children'?s)\b"),
    ("sauces section", r"\b(sauces?|dips?|dressings?)\b"),
    ("add-ons section", r"\b(extras?|add[- ]?ons?|additions?|toppings?|modifiers?)\b"),
    ("catering section", r"\b(catering|family meals?|family style|party trays?)\b"),
]
# Fixed values.
ADD_ON_SECTION = r"\belevate\b|\benhance\w*\b|\badd[- ]?ons?\b|\badditions?\b|\bupgrades?\b|\bmake it a meal\b|\bfor the table\b|\bpremium (sides?|additions?|add[- ]?ons?)\b|\ba la carte\b|\bon the side\b|\bsteak (sides?|enhancements?|additions?|toppers?)\b"
# Fixed values.
INCLUDED_SECTIONS = [
    r"\blimited time\b",
    r"\b(entrees?|entr[ée]es?|mains?|main courses?)\b",
    r"\b(bowls?|rice bowls?|grain bowls?|poke bowls?)\b",
    r"\bsalads?\b",
    r"\b(burgers?|smash burgers?)\b",
    r"\b(sandwiches|sandwhiches|handhelds?|subs?)\b",
    r"\bwraps?\b",
    r"\btacos?\b",
    r"\b(plates?|platters?|steaks?)\b",
    r"\bpastas?\b",
    r"\bpizzas?\b",
    r"\bsushi\b|\bnigiri\b|\bmaki\b",
    r"\bsoups?\b",
    r"\b(lunch|dinner|specialties|favorites|from the grill)\b",
]
# Fixed values.
SECTION_NAMES = [
    r"^limited time$",
    r"^(entrees?|mains?|main courses?|main plates?)$",
    r"^(bowls?|rice bowls?|grain bowls?|poke bowls?)$",
    r"^salads?$",
    r"^(burgers?|smash burgers?)$",
    r"^(sandwiches|sandwhiches|handhelds?|subs?)$",
    r"^wraps?$",
    r"^tacos?$",
    r"^(plates?|protein plates?|platters?)$",
    r"^pastas?$",
    r"^pizzas?$",
    r"^(sushi|nigiri|sashimi|maki|hand rolls?)$",
    r"^steaks?$",
    r"^(soups?|deli sides?(&| and )soups?|deli sides? & soups?)$",
    r"^(lunch|dinner|specialties|house favorites|favorites|from the grill)$",
    r"^small plates$",
    r"^side salads?$",
    r"^(drinks|beverages|soft drinks|sodas?|juices?|coffee|tea|smoothies)$",
    r"^(cocktails?|beer|wine|spirits|bar menu|draft list|happy hour)$",
    r"^(desserts?|sweets|pastries)$",
    r"^(sides?|side dishes|a la carte)$",
    r"^(appetizers?|apps|starters|shareables?|snacks)$",
    r"^(kids|kids? menu|children'?s menu|for the kids)$",
    r"^(sauces?|dips?|dressings?)$",
    r"^(extras?|add[- ]?ons?|additions?|toppings?|modifiers?)$",
    r"^(catering|family meals?|family style|party trays?)$",
]
# Fixed values.
EXCLUDED_ITEMS = [
    ("drink", r"\b(lemonade|soda|coke|pepsi|sprite|iced tea|hot tea|latte|espresso|cappuccino|juice|smoothie|milkshake|horchata|kombucha)\b|^coffee$"),
    ("alcohol", r"\b(beer|ipa|lager|pilsner|wine|margarita|mojito|cocktail|sangria|mimosa)\b"),
    ("dessert", r"\b(ice cream|gelato|brownie|cookie|churro|flan|tiramisu|cheesecake|sundae|pudding|milk shake)\b"),
    ("dessert", r"\b(chocolate|carrot|lava|birthday|coffee) cakes?$"),
    ("dessert", r"\b(apple|pecan|key lime|pumpkin|cherry|banana cream) pie$"),
    ("side", r"^(french |sweet potato |curly |waffle |garlic )?fries$"),
    ("side", r"^(tortilla |pita |potato )?chips$"),
    ("side", r"^(onion rings|coleslaw|side salad|garlic bread|bread basket|mashed potatoes|rice)$"),
    ("side", r"^side of\b"),
    ("add-on", r"^(add|extra)\s"),
    ("kids item", r"^(kids?|kid'?s)\s"),
    ("sauce", r"^(ranch|caesar|vinaigrette|bbq sauce|salsa|guacamole|aioli|hot sauce|pesto|marinara|alfredo|butter|olive oil)$"),
    ("sauce", r"^(?:[\w'-]+\s+){0,2}(sauces?|dressings?)$"),
    ("sauce", r"\bsauce\b.*\bsauce\b"),
    ("modifier", r"^\(.*\)$"),
    ("customizable item", r"^(choice of|make your own|create your own|build your own)\b"),
]
# Fixed values.
SHARED = r"\b(feeds|serves)\s*(?:[2-9]|\d{2,})\b|\bfamily (meal|pack|style|bundle)\b|\bparty (pack|tray|platter)\b|\bfor (two|four)\b"
# What every match of the pattern above has, quick to search.
SHARED_HINT = "feeds|serves|family|party|for (?:two|four)"
# Fixed values.
VAGUE_NAMES = [
    r"\bchef['’]?s? (special|choice|selection)\b",
    r"\bhouse (special|specialty)\b",
    r"\b(daily|today['’]?s|seasonal) (special|selection|plate|catch)\b",
    r"\bmarket (fish|plate|price|special)\b",
    r"\bcatch of the day\b",
    r"\bask your server\b",
    r"\bspecial of the day\b",
]

# Words of which every match of the rule in the same place has one; an empty text: the rule is always searched.
DISH_WORDS = [
    "burger burgers cheeseburger cheeseburgers patty smash smashburger",
    "taco tacos",
    "fajita fajitas",
    "pizza pizzas flatbread flatbreads calzone",
    "pasta spaghetti fettuccine linguine rigatoni penne lasagna alfredo carbonara bolognese mac noodle noodles",
    "burrito burritos chimichanga chimichangas",
    "wrap wraps",
    "parm parmigiana parmesan",
    "sandwich sandwiches sub subs club panini hoagie melt blt torta cheesesteak banh",
    "salad salads",
    "bowl bowls poke",
    "soup soups chili stew ramen pho chowder",
    "sushi nigiri sashimi temaki uramaki hosomaki omakase roll",
    "roll",
]
NAME_WORDS = "plate plates platter platters entr entree combo halibut salmon sea seabass branzino cod cioppino filet rib ribeye ny new sirloin strip tomahawk porterhouse t tbone steak ribs pork chicken katsu piccata"
SECTION_TYPE_WORDS = [
    "bowl bowls",
    "salad salads",
    "sandwiches handheld handhelds sub subs",
    "burger burgers",
    "wrap wraps",
    "burrito burritos",
    "taco tacos",
    "pasta pastas",
    "pizza pizzas",
    "sushi nigiri sashimi roll rolls maki",
    "plate plates platter platters steak steaks",
    "soup soups",
]
EXCLUDED_SECTION_WORDS = [
    "plates",
    "salad salads",
    "drinks beverages soda sodas juice juices coffee tea smoothies",
    "cocktail cocktails beer wine spirits bar draft happy",
    "dessert desserts sweets pastries",
    "side sides carte",
    "appetizer appetizers app apps starters shareable shareables snacks",
    "kid kids children childrens",
    "sauce sauces dip dips dressing dressings",
    "extra extras add addon addons addition additions topping toppings modifier modifiers",
    "catering family party",
]
INCLUDED_SECTION_WORDS = [
    "limited",
    "entree entrees entr main mains",
    "bowl bowls",
    "salad salads",
    "burger burgers",
    "sandwiches sandwhiches handheld handhelds sub subs",
    "wrap wraps",
    "taco tacos",
    "plate plates platter platters steak steaks",
    "pasta pastas",
    "pizza pizzas",
    "sushi nigiri maki",
    "soup soups",
    "lunch dinner specialties favorites grill",
]
SECTION_NAME_WORDS = [
    "limited",
    "entree entrees main mains",
    "bowl bowls",
    "salad salads",
    "burger burgers",
    "sandwiches sandwhiches handheld handhelds sub subs",
    "wrap wraps",
    "taco tacos",
    "plate plates platter platters",
    "pasta pastas",
    "pizza pizzas",
    "sushi nigiri sashimi maki roll rolls",
    "steak steaks",
    "soup soups",
    "lunch dinner specialties favorites grill",
    "small",
    "salad salads",
    "drinks beverages soda sodas juice juices coffee tea smoothies",
    "cocktail cocktails beer wine spirits bar draft happy",
    "dessert desserts sweets pastries",
    "side sides carte",
    "appetizer appetizers app apps starters shareable shareables snacks",
    "kid kids children childrens",
    "sauce sauces dip dips dressing dressings",
    "extra extras add addon addons addition additions topping toppings modifier modifiers",
    "catering family party",
]
EXCLUDED_ITEM_WORDS = [
    "lemonade soda coke pepsi sprite tea latte espresso cappuccino juice smoothie milkshake horchata kombucha coffee",
    "beer ipa lager pilsner wine margarita mojito cocktail sangria mimosa",
    "cream gelato brownie cookie churro flan tiramisu cheesecake sundae pudding shake",
    "cake cakes",
    "pie",
    "fries",
    "chips",
    "onion coleslaw salad garlic bread potatoes rice",
    "side",
    "add extra",
    "kid kids",
    "ranch caesar vinaigrette sauce salsa guacamole aioli pesto marinara alfredo butter oil",
    "sauce sauces dressing dressings",
    "sauce",
    "",
    "choice make create build",
]
VAGUE_WORDS = ["chef chefs", "house", "daily today todays seasonal", "market", "catch", "ask", "special"]


def heading(section: Column) -> Column:
    """A section's name without its closing colon or full stop."""
    return F.regexp_replace(F.trim(F.coalesce(section, F.lit(""))), "[:.]+$", "")


def section_type(section: Column) -> Column:
    return first_indexed(heading(section), SECTION_TYPES, SECTION_TYPE_WORDS)


def dish_type(name: Column, description: Column, section: Column) -> Column:
    """struct<dish_type, matched_on, section_supports>: by name, else description, else section, else unknown."""
    by_name = first_indexed(name, [*DISH_RULES, NAME_RULE], [*DISH_WORDS, NAME_WORDS])
    by_description = first_indexed(description, DISH_RULES, DISH_WORDS)
    by_section = section_type(section)

    def kind(by: Column) -> Column:
        found = F.coalesce(by["name"], by["description"], by["section"], F.lit("unknown"))
        on = F.when(by["name"].isNotNull(), "name").when(by["description"].isNotNull(), "description").when(by["section"].isNotNull(), "section").otherwise("none")
        supports = (by["name"].isNotNull() | by["description"].isNotNull()) & F.coalesce(by["section"] == found, F.lit(False))
        return F.struct(found.alias("dish_type"), on.alias("matched_on"), supports.alias("section_supports"))

    # arrays of one element, so that each cascade stands in the plan once; the description's is needed only where the name says nothing
    by = F.transform(F.array(by_name), lambda n: F.struct(n.alias("name"), F.when(n.isNull(), by_description).alias("description"), by_section.alias("section")))
    return F.transform(by, kind)[0]


def is_section_name(line: Column) -> Column:
    return any_indexed(heading(line), SECTION_NAMES, SECTION_NAME_WORDS)


def excluded_section(section: Column) -> Column:
    """The reason, or null."""
    return first_indexed(heading(section), EXCLUDED_SECTIONS, EXCLUDED_SECTION_WORDS)


def included_section(section: Column) -> Column:
    return any_indexed(heading(section), INCLUDED_SECTIONS, INCLUDED_SECTION_WORDS)


def add_on_section(section: Column) -> Column:
    return matches(heading(section), ADD_ON_SECTION)


def excluded_item(name: Column) -> Column:
    return first_indexed(F.trim(name), EXCLUDED_ITEMS, EXCLUDED_ITEM_WORDS)


def shared_portion(name: Column, description: Column) -> Column:
    both = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit("")))
    return F.lower(both).rlike(SHARED_HINT) & matches(both, SHARED)


def is_vague(name: Column) -> Column:
    return any_indexed(name, VAGUE_NAMES, VAGUE_WORDS)


def is_side(section: Column, kind: Column) -> Column:
    return (kind == "unknown") & add_on_section(section)


def exclusion_reason(name: Column, description: Column, section: Column, kind: Column) -> Column:
    """Why a dish is left out, or null where it is in. The first of: section, item, shared portion, nothing that says meal."""
    shared, said = shared_portion(name, description), F.coalesce(section, F.lit(""))

    def by_section(why: Column) -> Column:
        out = F.concat(F.lit('Listed under the "'), said, F.lit('" '), why)
        return F.when(why != "catering section", out).when(shared & why.isNotNull(), F.concat(F.lit('Shared or family-sized portion in the "'), said, F.lit('" section')))

    return F.coalesce(
        F.transform(F.array(excluded_section(section)), by_section)[0],
        F.concat(F.lit("Item looks like a "), excluded_item(name)),
        F.when(shared, "Shared or family-sized portion"),
        F.when((kind == "unknown") & ~included_section(section), "Could not identify this as an entree or meal"),
    )
