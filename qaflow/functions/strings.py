"""String functions with Python's notion of white space, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that Python's str.strip and str.split know. In Unicode mode ``\\s`` is one test of a character, where a
#: class of all the ranges would be nine.
SPACE = "(?U:[\\s\\x1c-\\x1f])"
#: The same characters as text: trimming looks at the ends only, where a regex would scan the whole text.
_TRIMMED = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Line ends of str.splitlines; the empty line inside "\\r\\n" goes with the other blank ones.
_LINE_END = "[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
SPECIAL = "<\\|[^>]+?\\|>"

#: An article between word boundaries, which are those of letters, digits and "_", so a combining mark ends a word.
ARTICLE = "(?<![\\p{L}\\p{N}_])(a|an|the)(?![\\p{L}\\p{N}_])"

IDK = "I don't know"
NO_CONTEXT = "i dont see any relevant context."
#: Refusal spellings after lower-casing and collapsing white space.
IDK_VARIANTS = (
    "i don't know",
    "i dont know",
    "i cannot find the answer in the context",
    "i can't find the answer in the context",
    "cannot find the answer in the context",
    "can't find the answer in the context",
    "not found in the context",
)
NO_CONTEXT_VARIANTS = (
    "i dont see any relevant context.",
    "i dont see any relevant context",
    "i don't see any relevant context.",
    "i don't see any relevant context",
    "no relevant context",
)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text(c: Column) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(text(c), F.lit(_TRIMMED))


def rstrip(c: Column) -> Column:
    return F.rtrim(text(c), F.lit(_TRIMMED))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text(c), f"{SPACE}+", " "))


def words(c: Column) -> Column:
    """Like str.split(): no empty words."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def normalize_text(c: Column) -> Column:
    return collapse(F.lower(text(c)))


def truncate_chars(c: Column, most: int) -> Column:
    """Strip; where longer than ``most``, cut and strip the cut end."""
    s = strip(c)
    return F.when(F.length(s) <= most, s).otherwise(rstrip(F.substring(s, 1, most)))


def truncate_words(c: Column, most: int) -> Column:
    """The first ``most`` words joined by single spaces; with ``most`` <= 0 only stripped."""
    return strip(c) if most <= 0 else F.array_join(F.slice(words(c), 1, most), " ")


def strip_meta(c: Column) -> Column:
    """Drop <|...|> tokens and sentence tags, collapse white space."""
    return collapse(F.regexp_replace(F.regexp_replace(text(c), SPECIAL, " "), "</?s>", " "))


def clean_content(c: Column, bold: bool = True) -> Column:
    """strip_meta without think/answer tags, a leading "answer:", and (``bold``) double asterisks."""
    s = F.regexp_replace(strip_meta(c), "(?i)</?(think|answer)>", " ")
    s = F.regexp_replace(s, f"(?i)^{SPACE}*(answer|final answer){SPACE}*:{SPACE}*", "")
    return collapse(F.replace(s, F.lit("**"), F.lit(" ")) if bold else s)


def lines(c: Column) -> Column:
    """Stripped non-empty lines."""
    return F.filter(F.transform(F.split(text(c), _LINE_END), strip), lambda x: x != "")


def last_line(c: Column) -> Column:
    return F.coalesce(F.try_element_at(lines(c), F.lit(-1)), F.lit(""))


def normalize_field(c: Column) -> Column:
    """strip_meta without double asterisks, then blanks and quotes off the ends."""
    return strip_chars(collapse(F.replace(strip_meta(c), F.lit("**"), F.lit(" "))), " \t\n\r\"'`")


def normalize_answer_text(c: Column) -> Column:
    """The final answer: last bold span, cleaned, without #s, a label and quotes; '' for facts/bridge/check labels."""
    spans = F.regexp_extract_all(text(c), F.lit("(?s)\\*\\*(.+?)\\*\\*"), 1)
    s = clean_content(F.coalesce(F.try_element_at(spans, F.lit(-1)), text(c)))
    s = F.regexp_replace(s, f"^#+{SPACE}*", "")
    s = F.regexp_replace(s, f"(?i)^{SPACE}*(?:answer|final answer){SPACE}*[:\\-]{SPACE}*", "")
    s = strip_chars(strip(s), " \t\n\r\"'`")
    return F.when(s.rlike(f"(?i)^(facts|bridge|check){SPACE}*:"), F.lit("")).otherwise(s)


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, articles replaced by a space, white space collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(text(c)), "\\p{Punct}", ""), ARTICLE, " "))


def canonical_answer(c: Column, idk: str = IDK, no_context: str = NO_CONTEXT, extra_idk: tuple = ()) -> Column:
    """Refusal spellings become ``idk`` or ``no_context``; other answers are stripped."""
    squeeze = lambda x: " ".join(x.lower().split())
    n = normalize_text(c)
    return (
        F.when(n.isin(*{squeeze(idk), *IDK_VARIANTS, *map(squeeze, extra_idk)}), F.lit(idk))
        .when(n.isin(*{squeeze(no_context), *NO_CONTEXT_VARIANTS}), F.lit(no_context))
        .otherwise(strip(c))
    )


def free_text_refusal(c: Column, idk: str) -> Column:
    """Free-text answers that begin with "i don't know", or are "i dont know", become ``idk``."""
    s = strip(c)
    return F.when(F.lower(s).startswith("i don't know") | (F.lower(s) == "i dont know"), F.lit(idk)).otherwise(s)


def contains_answer(raw: Column, answer: Column) -> Column:
    """The stripped answer occurs in the stripped output, ignoring case; an empty answer never does."""
    a = F.lower(strip(answer))
    return (a != "") & F.contains(F.lower(strip_meta(raw)), a)


def to_bool(c: Column, kind: str) -> Column:
    """Booleans, non-zero numbers and {1, true, t, yes, y}; null is false. ``kind`` is the column's Spark type."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.lower(strip(c)).isin("1", "true", "t", "yes", "y")
    return F.coalesce(c != 0, F.lit(False))


def csv_items(c: Column) -> Column:
    """Stripped non-empty items of a comma list."""
    return F.filter(F.transform(F.split(text(c), ","), strip), lambda x: x != "")


def parse_ratios(spec: str, classes: tuple[str, ...]) -> dict[str, float]:
    """``a:1,b:2`` as shares that sum to one; unknown classes, or a sum of zero, are errors."""
    given = {k.strip(): float(v) for k, v in (part.split(":", 1) for part in spec.split(",") if part.strip())}
    if unknown := sorted(set(given) - set(classes)):
        raise ValueError(f"unknown classes {unknown}; known are {list(classes)}")
    total = sum(given.values())
    if total <= 0:
        raise ValueError("ratios must sum to more than zero")
    return {c: given.get(c, 0.0) / total for c in classes}


def ratio_shares(spec: Column, classes: tuple[str, ...]) -> Column:
    """``parse_ratios`` for a column: map of class to share, null where the weights sum to no more than zero; an unknown class is an error."""
    weight = "struct<name:string,weight:double>"
    pairs = F.transform(
        csv_items(spec), lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("name"), strip(F.regexp_replace(x, "^[^:]*:", "")).cast("double").alias("weight")).cast(weight)
    )
    unknown = F.array_except(F.transform(pairs, lambda p: p["name"]), F.array(*map(F.lit, classes)))

    def last(name: str) -> Column:
        of_name = F.filter(pairs, lambda p: p["name"] == name)
        return F.coalesce(F.when(F.size(of_name) > 0, F.element_at(of_name, -1)["weight"]), F.lit(0.0))

    given = [last(c) for c in classes]
    total = sum(given[1:], given[0])
    shares = F.create_map(*[x for c, g in zip(classes, given) for x in (F.lit(c), g / total)])
    wrong = F.raise_error(F.concat(F.lit("unknown classes "), F.array_join(unknown, ", "))).cast("map<string,double>")
    return F.when(F.size(unknown) > 0, wrong).when(total > 0, shares)


def run_name_number(c: Column) -> Column:
    """A number for a run name: "." becomes p, "-" becomes m, other signs go."""
    return F.regexp_replace(F.translate(c.cast("string"), ".-", "pm"), "[^A-Za-z0-9]", "")


def output_dir(c: Column) -> Column:
    """Final slashes, a file name ending in .parquet and a .rankN suffix go."""
    s = F.regexp_replace(text(c), "/+$", "")
    s = F.when(s.endswith(".parquet"), F.regexp_replace(s, "/?[^/]*$", "")).otherwise(s)
    return F.regexp_replace(s, "\\.rank[0-9]+$", "")


def between(c: Column, start: str, end: str) -> Column:
    """Stripped text after the first ``start`` up to the next ``end`` or the end; '' without ``start``."""
    at = F.locate(start, c)
    tail = F.substring(c, at + len(start), F.length(c))
    stop = F.locate(end, tail)
    return F.when(at == 0, F.lit("")).otherwise(strip(F.when(stop == 0, tail).otherwise(F.substring(tail, F.lit(1), stop - 1))))


def cut_at(c: Column, end: str) -> Column:
    """The text before ``end``."""
    return F.substring_index(text(c), end, 1)
