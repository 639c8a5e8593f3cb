"""SQL for the queries that cost dishes: the same tables as rows, the work as joins.

`costed(source)` gives common table expressions that end in `e`, one row per dish of
`source`, which has a key `item` and dish_name, description, dish_type and supports.
"""

from __future__ import annotations

from .. import dims


def quoted(x: object) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x).lower()


def values(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)


def has(*keys: str) -> str:
    return f"list_has_any(keys, [{', '.join(map(quoted, keys))}])"


def number(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN floor({x})::BIGINT::VARCHAR ELSE ({x})::VARCHAR END"


def portion(amount: str, unit: str) -> str:
    return f"{number(amount)} || ' ' || {unit} || CASE WHEN {unit} IN ('serving', 'cup') AND {amount} <> 1 THEN 's' ELSE '' END"


SWEETS = ("bbq_sauce", "teriyaki_sauce", "honey", "sweet_glaze")
CREAMS = ("mayo", "crema", "ranch_dressing", "caesar_dressing", "alfredo_sauce", "pesto")
COOKED = ("chicken_breast", "steak", "beef", "turkey", "shrimp", "white_fish", "tuna", "pork", "tofu")


def costed(source: str) -> str:
    return rf"""
food(food_key, label, serving, serving_unit, cal, pro, carb, fat, condiment) AS (VALUES {values(dims.nutrition_rows())}),
alias(alias, ord, ingredient, category, slot, food_key) AS (VALUES {values([r for r in dims.alias_rows() if "-" not in r[0]])}),
template(kind, slot_ord, slot, amount, unit, default_key, assume) AS (VALUES {values(dims.template_rows())}),
src AS (
  SELECT *, coalesce(dish_name, '') || ' ' || coalesce(description, '') AS said, CASE WHEN dish_type = 'unknown' THEN 'plate' ELSE dish_type END AS kind,
    lower(trim(regexp_extract(coalesce(dish_name, ''), '^\s*(?:1/2|½|[Hh][Aa][Ll][Ff])\s+(.+)$', 1))) AS half_of FROM {source}
), sig AS (
  SELECT *, string_split(trim(regexp_replace(lower(said), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws,
    regexp_matches(said, '\b(fried|crispy|breaded|battered|panko|tempura|katsu|crunchy)\b', 'i') AS fried,
    regexp_matches(said, '\b(creamy|cream sauce|queso|alfredo|ranch|aioli|crema|smothered|au gratin|gratin)\b', 'i') AS creamy,
    regexp_matches(said, '\b(glazed?|honey|teriyaki|bbq|barbecue|sweet chili|hoisin)\b', 'i') AS sweet,
    regexp_matches(said, '\b(double|extra)\s+(protein|chicken|beef|steak|meat|shrimp|prawns?|salmon|tuna|tofu)\b', 'i') AS twice,
    regexp_matches(said, '\b(lettuce wrap(ped)?|no bun|bunless|protein style|no bread|no tortilla)\b', 'i') AS no_bread,
    regexp_matches(said, '\b(chili caramel|caramel glaze|gochujang|char ?siu|sticky soy)\b', 'i') AS caramel, regexp_matches(said, '\b(extra|double) cheese\b', 'i') AS cheesy, regexp_matches(said, '\b(low[- ]carb|keto|no rice)\b', 'i') AS no_carb,
    half_of <> '' AND split_part(half_of, ' ', 1) NOT IN ('lb', 'lbs', 'pound', 'oz', 'ounce', 'ounces', 'dozen', 'kg', 'rack', 'slab') AND NOT regexp_matches(half_of, '\bribs?\b')
      AND NOT (split_part(half_of, ' ', -1) IN ('chicken', 'bird') AND len(list_filter(string_split(half_of, ' ')[:-2], lambda w: w NOT IN ('rotisserie', 'roast', 'roasted', 'smoked', 'grilled', 'fried', 'bbq', 'jerk', 'herb'))) = 0) AS half,
    -- a weight right before a cut, else the first weight that no side follows, if the name is a steak's
    try_cast(regexp_extract(lower(said), '([0-9.]+) ?oz\.? (?:of )?(?:prime |dry[- ]aged |bone[- ]in |blackened |grilled |seared |top )*(?:sirloin|rib[- ]?eye|new york|ny\b|strip|filet|tenderloin|steak|porterhouse|t[- ]?bone|wagyu|chicken|breast|salmon|prawn|shrimp|tuna|pork|lamb|halibut|cod)', 1) AS DOUBLE) AS cut,
    CASE WHEN regexp_matches(lower(dish_name), '\b(sirloin|rib[- ]?eye|new york|ny strip|strip|filet|tenderloin|porterhouse|t[- ]?bone|tomahawk|wagyu|steak)\b') THEN
      try_cast(regexp_extract(regexp_replace(lower(said), '[0-9.]+ ?oz\.? ?(fries|chips|rice|potato|salad|slaw|vegetable|sauce|dip|butter)', '', 'g'), '([0-9.]+) ?oz\b', 1) AS DOUBLE) END AS bare FROM src
), prep AS (SELECT *, coalesce(CASE WHEN cut BETWEEN 4 AND 40 THEN cut END, CASE WHEN bare BETWEEN 4 AND 40 THEN bare END) AS ounces FROM sig),
gram AS (SELECT item, pos - 1 AS pos, n, array_to_string(ws[pos:pos + n - 1], ' ') AS alias FROM (SELECT item, ws, unnest(range(1, len(ws) + 1)) AS pos FROM prep), (VALUES (1), (2), (3)) s(n) WHERE pos + n - 1 <= len(ws)),
hit AS (SELECT * FROM gram JOIN alias USING (alias)),
in_order AS (SELECT item, list({{'ord': ord, 'pos': pos, 'n': n}} ORDER BY ord, pos) AS hits FROM hit GROUP BY item),
greedy AS (SELECT item, unnest(list_reduce(hits, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.pos < x[1].pos + x[1].n AND x[1].pos < y.pos + y.n)) > 0 THEN acc ELSE list_concat(acc, x) END, [])) AS x FROM (SELECT item, list_transform(hits, lambda h: [h]) AS hits FROM in_order)),
free AS (SELECT h.* FROM hit h JOIN greedy g ON g.item = h.item AND g.x.ord = h.ord AND g.x.pos = h.pos AND g.x.n = h.n),
once AS (SELECT * FROM free JOIN food USING (food_key) QUALIFY row_number() OVER (PARTITION BY item, ingredient ORDER BY ord, pos) = 1),
slots AS (
  SELECT p.item, t.slot_ord, t.slot, t.unit, t.default_key, t.assume OR (t.slot = 'cheese' AND p.cheesy) AS assume,
    CASE WHEN t.slot = 'protein' AND p.ounces IS NOT NULL THEN p.ounces WHEN (t.slot = 'protein' AND p.twice) OR (t.slot = 'cheese' AND p.cheesy) THEN 2 * t.amount ELSE t.amount END AS amount,
    (t.slot = 'bread' AND (p.no_bread OR p.no_carb)) OR (t.slot = 'carb' AND p.no_carb) AS gone
  FROM prep p JOIN template t USING (kind)
), placed AS (
  SELECT o.*, s.amount, s.unit, s.slot IS NOT NULL AS slotted, replace(p.kind, '_', ' ') AS kind_label, count(*) FILTER (WHERE NOT o.condiment) OVER g AS bulk, min(o.pos) OVER g AS first_at
  FROM once o JOIN prep p USING (item) LEFT JOIN slots s ON s.item = o.item AND s.slot = o.slot AND NOT s.gone WINDOW g AS (PARTITION BY o.item, o.slot)
), cost AS (
  SELECT *, condiment OR slotted OR slot IN ('cheese', 'sauce', 'fat') AS counted, condiment OR slotted AS fills, coalesce(unit = serving_unit, false) AS scales,
    CASE WHEN NOT (condiment OR slotted OR slot IN ('cheese', 'sauce', 'fat')) THEN 0.0::DOUBLE WHEN NOT condiment AND slotted AND unit = serving_unit THEN amount / bulk / serving ELSE 1.0::DOUBLE END AS factor,
    floor(amount / bulk * 10 + 0.5) / 10 AS share FROM placed
), one AS (SELECT *, CASE WHEN regexp_matches(kind_label, '^[aeiou]') THEN 'an ' ELSE 'a ' END || kind_label AS a_kind FROM cost),
said AS (
  SELECT *, CASE WHEN condiment THEN 'Assumed 1 standard serving of ' || label || '.' WHEN NOT slotted AND NOT counted THEN 'Did not count ' || label || ' — likely a side or garnish rather than part of ' || a_kind || '.'
    WHEN NOT slotted THEN 'Counted 1 standard serving of ' || label || ' (' || a_kind || ' has no set ' || slot || ' portion).'
    WHEN scales THEN 'Assumed ' || {portion("share", "unit")} || ' of ' || label || '.' ELSE 'Assumed 1 standard serving of ' || label || ' (portion units differ).' END AS note FROM one
), by_match AS (
  SELECT item, list(slot) FILTER (WHERE fills) AS filled, list(food_key) FILTER (WHERE counted) AS keys, list(slot) AS found_slots, count(*) AS n, list(ingredient ORDER BY pos) AS ingredients, list(alias) AS raw,
    sum(cal * factor) AS cal, sum(pro * factor) AS pro, sum(carb * factor) AS carb, sum(fat * factor) AS fat, list(note ORDER BY first_at, NOT condiment, pos) AS notes FROM said GROUP BY item
), assumed AS (
  SELECT s.item, s.slot, s.slot_ord, f.food_key, CASE WHEN f.condiment OR s.unit <> f.serving_unit THEN 1.0::DOUBLE ELSE s.amount / f.serving END AS factor, f.cal, f.pro, f.carb, f.fat,
    'Assumed ' || {portion("s.amount", "s.unit")} || ' of ' || f.label || ' — typical for ' || CASE WHEN regexp_matches(p.kind, '^[aeiou]') THEN 'an ' ELSE 'a ' END || replace(p.kind, '_', ' ') || '.' AS note
  FROM slots s JOIN prep p USING (item) JOIN food f ON f.food_key = s.default_key LEFT JOIN by_match m ON m.item = s.item
  WHERE s.assume AND NOT s.gone AND NOT coalesce(list_contains(m.filled, s.slot), false)
), by_slot AS (
  SELECT item, list(slot) AS filled, list(food_key) AS keys, sum(cal * factor) AS cal, sum(pro * factor) AS pro, sum(carb * factor) AS carb, sum(fat * factor) AS fat, list(note ORDER BY slot_ord) AS notes FROM assumed GROUP BY item
), removed AS (SELECT item, string_agg(slot, ' and ' ORDER BY slot_ord) AS removed FROM slots WHERE gone GROUP BY item),
sums AS (
  SELECT p.*, list_concat(coalesce(m.filled, []), coalesce(a.filled, [])) AS filled, list_concat(coalesce(m.keys, []), coalesce(a.keys, [])) AS keys, coalesce(m.found_slots, []) AS found_slots, coalesce(m.n, 0) AS n, coalesce(m.ingredients, []) AS ingredients,
    coalesce(m.raw, []) AS raw, list_concat(coalesce(m.notes, []), coalesce(a.notes, [])) AS notes, r.removed,
    coalesce(m.cal, 0) + coalesce(a.cal, 0) AS cal, coalesce(m.pro, 0) + coalesce(a.pro, 0) AS pro, coalesce(m.carb, 0) + coalesce(a.carb, 0) AS carb, coalesce(m.fat, 0) + coalesce(a.fat, 0) AS fat
  FROM prep p LEFT JOIN by_match m USING (item) LEFT JOIN by_slot a USING (item) LEFT JOIN removed r USING (item)
), adds AS (
  SELECT *, fried AND NOT {has("fried_chicken")} AS add_fried, creamy AND NOT {has(*CREAMS)} AS add_creamy, sweet AND NOT caramel AND NOT {has(*SWEETS)} AS add_sweet, caramel AND NOT {has(*SWEETS)} AS add_caramel, {has(*COOKED)} AND NOT fried AND NOT {has("olive_oil", "butter")} AS oil FROM sums
), grams AS (SELECT *, 12 * add_fried::INTEGER + 2 * add_creamy::INTEGER + 15 * add_sweet::INTEGER + 40 * add_caramel::INTEGER AS more_carb, 10 * add_fried::INTEGER + 9 * add_creamy::INTEGER + 6 * oil::INTEGER + 9 * add_caramel::INTEGER AS more_fat FROM adds),
phrases AS (
  SELECT *, list_filter([trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) for x in regexp_split_to_array(coalesce(description, ''), '(?i),|;|\band\b|\bwith\b|\bover\b|\btopped with\b|&')], lambda x: length(x) >= 3) AS ps FROM grams
), total AS (
  SELECT *, CASE WHEN half THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS times, len(ps) AS phrases, len(list_filter(ps, lambda x: len(list_filter(raw, lambda y: contains(x, y))) > 0)) AS known FROM phrases
), e AS (
  SELECT *, floor(floor((cal + 4 * more_carb + 9 * more_fat) * times * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE / 5 + 0.5) * 5 AS calories, floor(floor(pro * times * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE + 0.5) AS protein_g,
    floor(floor((carb + more_carb) * times * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE + 0.5) AS carbs_g, floor(floor((fat + more_fat) * times * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE + 0.5) AS fat_g,
    floor(least(0.85::DOUBLE, greatest(0, least(1, 0.3::DOUBLE + CASE WHEN dish_type <> 'unknown' THEN 0.15::DOUBLE ELSE -0.1::DOUBLE END + CASE WHEN list_contains(found_slots, 'protein') THEN 0.15::DOUBLE ELSE 0 END
      + CASE WHEN description IS NOT NULL THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END + CASE WHEN n >= 3 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN list_contains(filled, 'protein') AND list_has_any(filled, ['carb', 'bread', 'vegetable']) THEN 0.1::DOUBLE ELSE 0 END
      + CASE WHEN supports THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN phrases > 0 AND known / phrases < 0.5 THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(dish_name, '^chef''?s special$', 'i') THEN 0.15::DOUBLE ELSE 0 END))) * 100 + 0.5) / 100 AS macro_confidence,
    array_to_string(list_concat(list_filter([
      CASE WHEN dish_type = 'unknown' THEN 'Dish type not recognized; used generic plate portions.' END, CASE WHEN twice THEN 'Doubled the protein portion for a double/extra protein item.' END,
      CASE WHEN ounces IS NOT NULL THEN 'Used the ' || CASE WHEN ounces = floor(ounces) THEN ounces::BIGINT::VARCHAR ELSE ounces::VARCHAR END || ' oz protein portion stated on the menu.' END,
      CASE WHEN cheesy THEN 'Doubled the cheese portion for an extra-cheese item.' END,
      CASE WHEN removed IS NOT NULL THEN 'Removed the ' || removed || ' portion — the item is described as low-carb or served without it.' END], lambda x: x IS NOT NULL), notes, list_filter([
      CASE WHEN add_fried THEN 'Added breading and frying oil for a fried/crispy item.' WHEN fried THEN 'Fried/crispy preparation is already included in the fried chicken values.' END,
      CASE WHEN add_creamy THEN 'Added fat for a creamy sauce or dressing.' WHEN creamy THEN 'Creamy preparation is already included in the sauce values.' END,
      CASE WHEN add_caramel THEN 'Added a caramel/gochujang glaze — reduced sugar plus oil, generously coating the protein.' WHEN caramel THEN 'Caramel glaze is already included in the sauce values.' END,
      CASE WHEN add_sweet THEN 'Added sugar for a glazed, honey, teriyaki, or BBQ item.' WHEN sweet AND NOT caramel THEN 'Sweet glaze is already included in the sauce values.' END,
      CASE WHEN oil THEN 'Added ~1–2 tsp of restaurant cooking oil — grilled and roasted proteins are rarely cooked dry.' END,
      CASE WHEN half THEN 'Halved the estimate — the name marks this as a half portion.' END], lambda x: x IS NOT NULL)), ' ') AS assumptions
  FROM total
)"""
