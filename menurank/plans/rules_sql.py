"""SQL of dish types and inclusion from lists of its own: phrases of plain words, found in a text's words one after the other."""

from __future__ import annotations

# Fixed values of this file: words and phrases, by commas, after the menu vocabulary that the rules stand for.
KINDS = [
    ("burger", "burger, burgers, cheeseburger, cheeseburgers, patty melt, smash burger, smashburger"),
    ("taco", "taco, tacos"),
    ("fajita", "fajita, fajitas"),
    ("pizza", "pizza, pizzas, flatbread, flatbreads, calzone"),
    ("pasta", "pasta, spaghetti, fettuccine, linguine, rigatoni, penne, lasagna, alfredo, carbonara, bolognese, mac and cheese, mac cheese, noodle, noodles"),
    ("burrito", "burrito, burritos, chimichanga, chimichangas"),
    ("wrap", "wrap, wraps"),
    ("parmigiana", "parmigiana, chicken parm, veal parm, eggplant parm, shrimp parm, chicken parmesan, veal parmesan, eggplant parmesan, shrimp parmesan"),
    ("sandwich", "sandwich, sandwiches, sub, subs, club, panini, hoagie, melt, blt, torta, cheesesteak, banh mi"),
    ("salad_with_protein", "salad, salads"),
    ("bowl", "bowl, bowls, poke"),
    ("soup", "soup, soups, stew, ramen, pho, chowder"),
    ("sushi", "sushi, nigiri, sashimi, temaki, uramaki, hosomaki, omakase, hand roll"),
]
PLATES = "plate, plates, platter, platters, entree, entr e, combo, halibut, salmon, sea bass, seabass, branzino, cod, cioppino, filet, rib eye, ribeye, ny strip, new york, sirloin, strip, tomahawk, porterhouse, t bone, tbone, steak, rib, ribs, pork, chicken, katsu, piccata"
NO_SOUP = "glaze, oil, crisp, crunch, sauce, paste, flake, caramel, lime, garlic, aioli, mayo, butter, jam"
ROLLED = "tuna, salmon, ahi, yellowtail, hamachi, crab, california, dragon, rainbow, eel, unagi, tempura, tobiko"
HEADED = [
    ("bowl", "bowl, bowls, rice bowl, rice bowls, grain bowl, grain bowls, poke bowl, poke bowls"),
    ("salad_with_protein", "salad, salads"),
    ("sandwich", "sandwiches, handheld, handhelds, sub, subs"),
    ("burger", "burger, burgers, smash burger, smash burgers"),
    ("wrap", "wrap, wraps"),
    ("burrito", "burrito, burritos"),
    ("taco", "taco, tacos"),
    ("pasta", "pasta, pastas"),
    ("pizza", "pizza, pizzas"),
    ("sushi", "sushi, nigiri, sashimi, roll, rolls, hand roll, hand rolls, maki"),
    ("plate", "plate, plates, protein plate, protein plates, platter, platters, steak, steaks"),
    ("soup", "soup, soups"),
]
OUT = [
    ("small plates section", "small plates"),
    ("side salads section", "side salad, side salads"),
    ("drinks section", "drinks, beverages, soft drinks, soda, sodas, juice, juices, coffee, tea, smoothies"),
    ("alcohol section", "cocktail, cocktails, beer, wine, spirits, bar menu, draft list, happy hour"),
    ("dessert section", "dessert, desserts, sweets, pastries"),
    ("sides section", "side, sides, side dishes, a la carte"),
    ("appetizers section", "appetizer, appetizers, app, apps, starters, shareable, shareables, snacks"),
    ("kids section", "kid, kids, childrens, children s"),
    ("sauces section", "sauce, sauces, dip, dips, dressing, dressings"),
    ("add-ons section", "extra, extras, add on, add ons, addon, addons, addition, additions, topping, toppings, modifier, modifiers"),
    ("catering section", "catering, family meal, family meals, family style, party tray, party trays"),
]
ADDED = "elevate, add on, add ons, addon, addons, addition, additions, upgrade, upgrades, make it a meal, for the table, premium side, premium sides, a la carte, on the side, steak side, steak sides, steak enhancement, steak addition, steak topper, steak toppers"
IN = "limited time, entree, entrees, entr e, entr es, main, mains, main course, bowl, bowls, salad, salads, burger, burgers, sandwiches, sandwhiches, handheld, handhelds, sub, subs, wrap, wraps, taco, tacos, plate, plates, platter, platters, steak, steaks, pasta, pastas, pizza, pizzas, sushi, nigiri, maki, soup, soups, lunch, dinner, specialties, favorites, from the grill"
NAMED = (
    "limited time, entree, entrees, main, mains, main course, main courses, main plate, main plates, bowl, bowls, rice bowl, rice bowls, grain bowl, grain bowls, poke bowl, poke bowls, salad, salads, burger, burgers, smash burger, smash burgers, "
    "sandwiches, sandwhiches, handheld, handhelds, sub, subs, wrap, wraps, taco, tacos, plate, plates, protein plate, protein plates, platter, platters, pasta, pastas, pizza, pizzas, sushi, nigiri, sashimi, maki, hand roll, hand rolls, steak, steaks, "
    "soup, soups, deli side & soup, deli sides & soups, deli side and soup, deli sides and soups, lunch, dinner, specialties, house favorites, favorites, from the grill, small plates, side salad, side salads, drinks, beverages, soft drinks, soda, sodas, "
    "juice, juices, coffee, tea, smoothies, cocktail, cocktails, beer, wine, spirits, bar menu, draft list, happy hour, dessert, desserts, sweets, pastries, side, sides, side dishes, a la carte, appetizer, appetizers, app, apps, starters, shareable, shareables, snacks, "
    "kids, kid menu, kids menu, childrens menu, children's menu, for the kids, sauce, sauces, dip, dips, dressing, dressings, extra, extras, add-on, add-ons, add on, add ons, addon, addons, addition, additions, topping, toppings, modifier, modifiers, "
    "catering, family meal, family meals, family style, party tray, party trays"
)
DRINKS = "lemonade, soda, coke, pepsi, sprite, iced tea, hot tea, latte, espresso, cappuccino, juice, smoothie, milkshake, horchata, kombucha"
ALCOHOL = "beer, ipa, lager, pilsner, wine, margarita, mojito, cocktail, sangria, mimosa"
SWEETS = "ice cream, gelato, brownie, cookie, churro, flan, tiramisu, cheesecake, sundae, pudding, milk shake"
CAKES = "chocolate cake, carrot cake, lava cake, birthday cake, coffee cake, chocolate cakes, carrot cakes, lava cakes, birthday cakes, coffee cakes, apple pie, pecan pie, key lime pie, pumpkin pie, cherry pie, banana cream pie"
SIDES = "fries, french fries, sweet potato fries, curly fries, waffle fries, garlic fries, chips, tortilla chips, pita chips, potato chips, onion rings, coleslaw, side salad, garlic bread, bread basket, mashed potatoes, rice"
SAUCES = "ranch, caesar, vinaigrette, bbq sauce, salsa, guacamole, aioli, hot sauce, pesto, marinara, alfredo, butter, olive oil"
VAGUE = (
    "chef special, chefs special, chef s special, chef choice, chefs choice, chef s choice, chef selection, chefs selection, chef s selection, house special, house specialty, daily special, daily selection, daily plate, daily catch, today special, today s special, "
    "today s selection, today s plate, today s catch, seasonal special, seasonal selection, seasonal plate, seasonal catch, market fish, market plate, market price, market special, catch of the day, ask your server, special of the day"
)


def listed(phrases: str) -> str:
    return ", ".join("'" + p.strip().replace("'", "''") + "'" for p in phrases.split(","))


def tokens(x: str) -> str:
    """A text's words in lower case, a space before and after each."""
    return f"' ' || array_to_string(regexp_extract_all(lower({x}), '[a-z0-9_]+'), ' ') || ' '"


def holds(words: str, phrases: str) -> str:
    return f"coalesce(len(list_filter([{listed(phrases)}], lambda p: contains({words}, ' ' || p || ' '))) > 0, false)"


def ends(words: str, phrases: str) -> str:
    return f"coalesce(len(list_filter([{listed(phrases)}], lambda p: ends_with({words}, ' ' || p || ' '))) > 0, false)"


def cases(words: str, rules: list[tuple[str, str]], more: str = "") -> str:
    return "CASE " + " ".join(f"WHEN {holds(words, p)} THEN '{r}'" for r, p in rules) + f" {more} END"


def kind(x: str, more: str = "") -> str:
    """Of a text by name; chili is soup but as a flavour, a roll is sushi with a fish before it in the same run of words."""
    flavour = NO_SOUP.replace(", ", "|")
    plain = f"regexp_replace(lower({x}), '\\bchili\\s+(?:{flavour})', ' ', 'g')"
    soup = f"contains({tokens(plain)}, ' chili ')"
    roll = f"regexp_matches(lower({x}), '(?:^|[^a-z0-9_])(?:{ROLLED.replace(', ', '|')})(?:[ ''&-][a-z0-9_ ''&-]*)?[ ''&-]roll(?:$|[^a-z0-9_])')"
    head = " ".join(f"WHEN {holds(tokens(x), p)}{f' OR {soup}' if r == 'soup' else ''} THEN '{r}'" for r, p in KINDS)
    return f"CASE {head} WHEN {roll} THEN 'sushi' {more} END"


HEAD = "lower(regexp_replace(trim(coalesce(section, '')), '[:.]+$', ''))"
#: Of d (dish_name, description, section): t, with by_name, by_description, by_section, dish_type, matched_on.
KIND_CTE = f"""k AS (
  SELECT *, {kind("dish_name", f"WHEN {holds(tokens('dish_name'), PLATES)} THEN 'plate'")} AS by_name, {kind("description")} AS by_description,
    CASE {" ".join(f"WHEN {HEAD} IN ({listed(p)}) THEN '{r}'" for r, p in HEADED)} END AS by_section FROM d
), t AS (
  SELECT *, coalesce(by_name, by_description, by_section, 'unknown') AS dish_type,
    CASE WHEN by_name IS NOT NULL THEN 'name' WHEN by_description IS NOT NULL THEN 'description' WHEN by_section IS NOT NULL THEN 'section' ELSE 'none' END AS matched_on FROM k
)"""
NAME, SAID = "lower(trim(dish_name))", "lower(coalesce(dish_name, '') || ' ' || coalesce(description, ''))"
ITEM = f"""CASE WHEN {holds(tokens("dish_name"), DRINKS)} OR {NAME} = 'coffee' THEN 'drink' WHEN {holds(tokens("dish_name"), ALCOHOL)} THEN 'alcohol'
  WHEN {holds(tokens("dish_name"), SWEETS)} OR (regexp_matches({NAME}, '[a-z]$') AND {ends(tokens("dish_name"), CAKES)}) THEN 'dessert'
  WHEN {NAME} IN ({listed(SIDES)}) OR {NAME} = 'side of' OR starts_with({NAME}, 'side of ') THEN 'side' WHEN starts_with({NAME}, 'add ') OR starts_with({NAME}, 'extra ') THEN 'add-on'
  WHEN starts_with({NAME}, 'kid ') OR starts_with({NAME}, 'kids ') OR starts_with({NAME}, 'kid''s ') THEN 'kids item'
  WHEN {NAME} IN ({listed(SAUCES)}) OR (len(string_split_regex({NAME}, '\\s+')) <= 3 AND list_contains([{listed("sauce, sauces, dressing, dressings")}], string_split_regex({NAME}, '\\s+')[-1])
    AND regexp_matches({NAME}, '^[a-z0-9_''\\s-]+$')) OR len(regexp_extract_all({NAME}, '\\bsauce\\b')) >= 2 THEN 'sauce'
  WHEN starts_with({NAME}, '(') AND ends_with({NAME}, ')') THEN 'modifier'
  WHEN len(list_filter([{listed("choice of, make your own, create your own, build your own")}], lambda p: starts_with({tokens("dish_name")}, ' ' || p || ' ') AND starts_with({NAME}, p))) > 0 THEN 'customizable item' END"""
SHARED = f"""(coalesce(try_cast(regexp_extract({SAID}, '\\b(?:feeds|serves)\\s*(\\d+)\\b', 1) AS INTEGER) >= 2, false)
  OR {holds(tokens(SAID), "family meal, family pack, family style, family bundle, party pack, party tray, party platter, for two, for four")})"""
#: Of t: x, with x_section, x_item, x_shared.
OUT_CTE = f"x AS (SELECT *, {cases(tokens(HEAD), OUT)} AS x_section, {ITEM} AS x_item, {SHARED} AS x_shared FROM t)"
INCLUDED, SIDE = holds(tokens(HEAD), IN), f"({holds(tokens(HEAD), ADDED)} OR contains({tokens(HEAD)}, ' enhance'))"
SECTION_NAME, VAGUE_NAME = f"coalesce({HEAD} IN ({listed(NAMED)}), false)", holds(tokens("dish_name"), VAGUE)
