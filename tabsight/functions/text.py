"""Text expressions: trimming, null words, canonical case, money, name tokens."""

from pyspark.sql import Column, functions as F

# Words that mean "no value" when cleaning text.
NULL_WORDS = [
    "nan", "none", "null", "n/a", "na", "-", "", "unknown",
    "not available", "not applicable", "nil", "#n/a",
]
# Words counted as hidden missing values when profiling.
HIDDEN_NULL_WORDS = [
    "n/a", "na", "none", "null", "missing", "unknown", "#n/a", "nil", "-", ".", "?", "n.a.",
    "not available", "not applicable", "nan", "undefined",
]
# Cell texts read as null when a text file is loaded.
LOAD_NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Currency symbols and codes.
MONEY_SYMBOLS = "₹$€£¥₩"
MONEY_CODES = "usd|eur|gbp|inr|aud|cad|jpy|cny|rmb|yen|won"

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def quoted(name: str) -> Column:
    """Column by exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


# The characters that count as white space at the ends of a text.
WHITESPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))


def strip(c: Column) -> Column:
    """Trim without a regular expression; a clean text costs two comparisons."""
    return F.btrim(c, F.lit(WHITESPACE))


def to_number(c: Column) -> Column:
    """Strict numeric text to double, else null (Java suffixes such as '1d' are not numbers)."""
    t = strip(c.cast("string"))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def null_text(c: Column) -> Column:
    t = strip(c)
    return F.when(~F.lower(t).isin(NULL_WORDS), t)


def title_case(c: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere.

    ``initcap`` does it where letters only follow blanks; the piecewise form handles texts such as ``3rd`` or ``o'neil``.
    """
    words = F.split(F.lower(c), r"(?<=[^\p{L}])(?=\p{L})")
    raised = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1)))
    return F.when(c.rlike(r"[^\p{L} ]\p{L}"), F.array_join(raised, "")).otherwise(F.initcap(c))


def folded(c: Column) -> Column:
    """Separators and white space to single blanks, trimmed."""
    return strip(F.regexp_replace(c, r"[_\-\s]+", " "))


# Letters that lower case leaves as they are and case folding takes apart or unites.
FOLDED = {"ß": "ss", "ẞ": "ss", "ŉ": "ʼn", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
UNITED = {"ς": "σ", "ſ": "s", "µ": "μ"}


def casefold(c: Column) -> Column:
    """Lower case in which spellings that differ only by case agree: ß is ss, all sigmas are one, ligatures are letters."""
    apart = F.translate(F.lower(c), "".join(UNITED), "".join(UNITED.values()))
    for letter, letters in FOLDED.items():
        apart = F.replace(apart, F.lit(letter), F.lit(letters))
    return F.when(c.rlike(r"[^\x00-\x7F]"), apart).otherwise(F.lower(c))


def canonical_text(c: Column) -> Column:
    return title_case(casefold(null_text(folded(c))))


def category_label(c: Column) -> Column:
    t = folded(c)
    return F.when(t != "", casefold(t))


def name_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), 0))


def has_token(tokens: Column, words) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in sorted(words)]))


# The patterns below are fixed values: how money is written.
def money_text(c: Column) -> Column:
    """Money text to plain number text: brackets are minus, the last separator decides the decimals."""
    t = F.regexp_replace(strip(c), r"^\((.+)\)$", r"-$1")
    t = F.regexp_replace(F.regexp_replace(F.translate(t, MONEY_SYMBOLS, ""), r"\s+", ""), r"(?i)^rs\.?", "")
    t = strip(F.regexp_replace(t, rf"(?i)\b(?:{MONEY_CODES})\b", ""))

    def plain(body):
        comma, dot = body.contains(","), body.contains(".")
        no_dots, no_commas = F.translate(body, ".", ""), F.translate(body, ",", "")
        return (
            F.when(comma & dot & body.rlike(r",[^.,]*$"), F.translate(no_dots, ",", "."))
            .when(comma & dot, no_commas)
            .when(comma & body.rlike(r",\d{2}$"), F.translate(F.regexp_replace(body, r",(?=.*,)", ""), ",", "."))
            .when(comma, no_commas)
            .when(dot & body.rlike(r"\.\d{3}$"), no_dots)
            .when(dot, F.regexp_replace(body, r"\.(?=.*\.)", ""))
            .otherwise(body))

    def signed(text):
        body = F.regexp_replace(text, r"^[+-]", "")
        return F.when(body != "", F.concat(F.regexp_extract(text, r"^[+-]", 0), let(body, plain)))

    return let(t, signed)


def parse_money(c: Column) -> Column:
    return to_number(money_text(c))


def to_boolean(c: Column) -> Column:
    t = F.lower(strip(c.cast("string")))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)
