"""Text expressions: tokens, cleaning, identifiers. All are JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns and typographic replacements. (?U) makes \w Unicode-aware in Java.
TOKEN = r"(?U)[\w']+|[.,!?; \-—–\n]"
WORD = r"(?U)[\w']+"
LOSSLESS = r"(?U)[\w']+|[^\w']"
TYPOGRAPHIC = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("&hyphen;", "-"), ("&dash;", "-"), ("&mdash;", "—"), ("&apos;", "'"), ("&amp;", "&"))


def tokens(text: Column) -> Column:
    """Words and the listed punctuation, in order; everything else is dropped."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def lossless_tokens(text: Column) -> Column:
    """Tokens whose concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(LOSSLESS), F.lit(0))


def plain(text: Column) -> Column:
    """Typographic characters and entities replaced, in the listed order."""
    for old, new in TYPOGRAPHIC:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normal_tokens(text: Column) -> Column:
    return tokens(F.lower(plain(text)))


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<.*?>", "")


def starts_with_letter(word: Column) -> Column:
    return word.rlike(r"^\p{L}")


def only_letters(word: Column) -> Column:
    return word.rlike(r"^\p{L}+$")


def snake(name: Column) -> Column:
    """CamelCase to camel_case."""
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def camel(name: Column) -> Column:
    return F.replace(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def text_id(corpus: Column, own: Column) -> Column:
    return F.concat(F.lit("_"), corpus, F.lit("/"), own.cast("string"))


def corpus_of(id_: Column) -> Column:
    return F.split(F.substring(id_, 2, 1 << 30), "/")[0]


def slash_to_dot(key: Column) -> Column:
    """The first slash becomes a dot."""
    return F.regexp_replace(key, "^([^/]*)/", "$1.")


def zero_filled(key: Column, width: int) -> Column:
    """Padded on the left, never cut."""
    return F.when(F.length(key) < width, F.lpad(key, width, "0")).otherwise(key)


def last_segments(key: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(key, "/"), F.greatest(F.size(F.split(key, "/")) - n + 1, F.lit(1)), n), "/")


def letters_only_lower(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z]", "")


def year_in(text: Column) -> Column:
    """The first run of four digits as a number, or null."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit("")), F.lit("9999")).cast("int")


def padded_id(key: Column) -> Column:
    """First letter, then the rest filled to six digits."""
    rest = F.substring(key, 2, 1 << 30)
    return F.concat(F.substring(key, 1, 1), zero_filled(rest, 6))


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\n\s*\n")


def fenced_json(reply: Column) -> Column:
    """What stands in a ``` fence, or the whole reply."""
    inner = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(inner != "", F.trim(inner)).otherwise(F.trim(reply))


def corpus_id(corpus: Column, key: Column, widths: dict[str, int], underscored: list[str]) -> Column:
    """_corpus/id: ids of the corpora in widths are filled to so many digits, spaces of the underscored ones' become _."""
    out = key
    for name, width in widths.items():
        out = F.when(corpus == name, zero_filled(key, width)).otherwise(out)
    out = F.when(corpus.isin(*underscored), F.replace(key, F.lit(" "), F.lit("_"))).otherwise(out) if underscored else out
    return text_id(corpus, out)
