"""Scalar functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fusegrid.functions import lexicon as L


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, as a lambda's variable, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as it is, halves away from zero: SQL's round(double, n). ``F.round`` takes the shortest decimal text, which may show a half where the double is less."""
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def ratio(n: Column, d: Column, otherwise: float = 0.0) -> Column:
    """n / d as double, or a constant where d is 0."""
    return F.when(d != 0, n.cast("double") / d.cast("double")).otherwise(F.lit(otherwise))


def feedback_delta(kind: Column) -> Column:
    return F.when(kind == "thumbs_up", F.lit(0.1)).when(kind == "thumbs_down", F.lit(-0.15))


def updated_confidence(old: Column, delta: Column, low: float = 0.1, high: float = 0.99) -> Column:
    if not 0 <= low < high <= 1:
        raise ValueError("bounds must be 0 <= low < high <= 1")
    return clamp(old + delta, low, high)


def decay(factor: float, hop: Column) -> Column:
    if not 0 <= factor <= 1:
        raise ValueError("the decay factor must be from 0 to 1")
    return F.pow(F.lit(factor), hop)


def connectivity(count: Column, most: Column) -> Column:
    """ln(1 + count) / ln(1 + most); 0 if most is 0."""
    return F.when(most > 0, F.log1p(count.cast("double")) / F.log1p(most.cast("double"))).otherwise(F.lit(0.0))


def degree_score(degree: Column) -> Column:
    return F.least(degree / F.lit(50.0), F.lit(1.0))


def final_score(confidence: Column, similarity: Column, degree: Column) -> Column:
    return F.lit(0.5) * confidence + F.lit(0.3) * similarity + F.lit(0.2) * degree


def reward(base: Column, similarity: Column, connected: Column, negative: Column, weights=(0.4, 0.3, 0.2, 0.1)) -> Column:
    b, s, c, n = weights
    return clamp(F.lit(b) * base + F.lit(s) * similarity + F.lit(c) * connected - F.lit(n) * negative, 0.0, 1.0)


def weights_valid(weights) -> bool:
    return abs(sum(weights) - 1) < 0.001


def normalised_weights(weights) -> tuple[float, ...]:
    total = sum(weights)
    return tuple(w / total for w in weights) if total > 0 else tuple(weights)


def truth_expectation(frequency: Column, confidence: Column) -> Column:
    return confidence * (frequency - F.lit(0.5)) + F.lit(0.5)


def truth_color(value: Column, middle: float = 0.4) -> Column:
    return F.when(value >= 0.7, "green").when(value >= middle, "yellow").otherwise("red")


def backoff_ms(attempt: Column, base: float = 100.0, most: float = 10_000.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def improvement_percent(base: Column, new: Column) -> Column:
    return F.when(base != 0, (new - base) / base * F.lit(100.0)).otherwise(F.lit(0.0))


def nearest_rank(values: Column, share: float) -> Column:
    """sorted[round(share * (n - 1))] of an array, halves away from zero; null for an empty array."""
    at = F.round(F.lit(share) * (F.size(values) - 1)).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), at))


def sanitize_term(text: Column) -> Column:
    return F.translate(text, "-. :/#()", "_____")


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def category_term(category: Column) -> Column:
    return F.concat(F.lit("UI"), capitalize(category))


def system_term(system: Column) -> Column:
    return F.concat(F.lit("DS_"), F.replace(system, F.lit("-"), F.lit("_")))


def element_term(category: Column, classes: Column) -> Column:
    return F.concat(category_term(category), F.lit("_"), F.coalesce(sanitize_term(F.get(classes, F.lit(0))), F.lit("default")))


def token_category(name: Column, value: Column) -> Column:
    """Seven ordered rules on a design token's lower-cased name and value."""
    n, v = F.lower(name), F.lower(value)
    has = lambda *words: n.rlike("|".join(words))
    return (
        F.when(has(L.COLOR_NAMES) | v.startswith("#") | v.startswith("rgb") | v.startswith("hsl"), "Color")
        .when(has(L.SPACING_NAMES) | v.endswith("px") | v.endswith("rem") | v.endswith("em"), "Spacing")
        .when(has("font", "text", "line-height"), "Typography")
        .when(has("radius"), "BorderRadius")
        .when(has("shadow"), "Shadow")
        .when(has("animation", "transition"), "Animation")
        .otherwise("Other")
    )


def collection_of(system: Column) -> Column:
    """The collection of a design system's name or alias; null if unknown."""
    names = F.create_map(*[F.lit(x) for pair in L.COLLECTION_ALIASES.items() for x in pair])
    return F.try_element_at(names, F.lower(system))


def percent_truth(frequency: Column, confidence: Column) -> Column:
    return F.format_string("%%%.2f;%.2f%%", F.bround(frequency, 2), F.bround(confidence, 2))  # halves go to even


def bar_truth(statement: Column, frequency: Column, confidence: Column) -> Column:
    return F.concat(statement, F.lit(". {"), frequency.cast("string"), F.lit("|"), confidence.cast("string"), F.lit("}"))


def match_reason(confidence: Column, similarity: Column, degree: Column) -> Column:
    return F.format_string("confidence %.2f, similarity %.2f, connections %.2f", *[F.bround(x, 2) for x in (confidence, similarity, degree)])


def uuid_or_nil(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), F.lower(text)).otherwise("00000000-0000-0000-0000-000000000000")


def shorten(text: Column, most: int = 12) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def ensure_question(text: Column) -> Column:
    return F.when(text.endswith("?"), text).otherwise(F.concat(text, F.lit("?")))


def info_value(text: Column, key: str) -> Column:
    """Number after ``key:`` in text of key:value lines; null if absent."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, rf"(?m)^{key}:(\d+)", 1), F.lit("")), F.lit("999999999999999"))


def dominant(parts: dict[str, Column]) -> Column:
    """Name of the largest part; the last of equals."""
    return F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(parts.items())]))["k"]


def search_terms(text: Column, lexicon: dict[str, str]) -> Column:
    """Names whose pattern occurs, in the lexicon's order."""
    return F.filter(F.array(*[F.when(text.rlike(L.whole(p)), F.lit(n)) for n, p in lexicon.items()]), lambda x: x.isNotNull())


def intent(text: Column, intents: dict[str, str] = L.INTENTS) -> Column:
    out = None
    for name, pattern in intents.items():
        out = F.when(text.rlike(L.whole(pattern)), name) if out is None else out.when(text.rlike(L.whole(pattern)), name)
    return out.otherwise("find")


def context_words(text: Column, *captured: Column) -> Column:
    """Words of three letters or more, lower-cased, without stop words and captured terms; repeats stay."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[a-zA-Z]{3,}(?![A-Za-z0-9_])"), 0), F.lower)
    # bound, or the captured terms would be looked for again at every word
    return bound(F.concat(F.array(*map(F.lit, L.STOP_WORDS)), *captured), lambda known: F.filter(words, lambda w: ~F.array_contains(known, w)))
