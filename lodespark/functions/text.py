"""Text cleaning as JVM expressions, in the order the pipeline needs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Contractions and what they stand for, applied in this order.
CONTRACTIONS = [
    ("won't", "will not"), ("can't", "cannot"), ("shan't", "shall not"), ("let's", "let us"), ("n't", " not"), ("'re", " are"),
    ("'ve", " have"), ("'ll", " will"), ("'d", " would"), ("'m", " am"), ("it's", "it is"), ("that's", "that is"),
]
#: Stop words; the negations are kept in the text.
STOP_WORDS = (
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down "
    "during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my of off on "
    "once only or other our out over own same she so some such than that the their them then there these they this those through to too under "
    "until up very was we were what when where which while who whom why will with you your"
).split()
NEGATIONS = ["no", "not", "nor", "never", "none", "neither", "cannot", "without"]


def _accents() -> tuple[str, str]:
    """Characters that decompose to one base letter and marks, and their bases."""
    from_, to = [], []
    for c in map(chr, range(0xC0, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        base = "".join(p for p in parts if unicodedata.category(p) != "Mn")
        if len(parts) > 1 and len(base) == 1:
            from_.append(c)
            to.append(base)
    return "".join(from_), "".join(to)


_FROM, _TO = _accents()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"[̀-ͯ]", "")


def remove_emails(c: Column) -> Column:
    # a run is tried from its first character only, and whole or not at all
    return F.regexp_replace(c, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "")


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"(?:https?://|www\.)[^ \t\r\n]+", "")


def remove_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^<>]*>", "")


def expand_contractions(c: Column) -> Column:
    for short, full in CONTRACTIONS:
        c = F.regexp_replace(c, short, full)
    return c


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))


def clean_text(c: Column) -> Column:
    """Lower, accents, e-mails, urls, tags, contractions, punctuation spaced, letters only, squeezed; null stays null."""
    c = expand_contractions(remove_tags(remove_urls(remove_emails(strip_accents(F.lower(c))))))
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"([?.!,])", " $1 "), r"[^a-z]+", " "))


def remove_stop_words(c: Column) -> Column:
    """Cleaned text without stop words; negations stay."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS if w not in NEGATIONS])
    return F.array_join(F.filter(F.split(c, " "), lambda w: ~F.array_contains(stop, w) & (w != "")), " ")


def words(c: Column, least: int = 3) -> Column:
    """Lower-case runs of at least ``least`` letters."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[a-z]{{{least},}}"), F.lit(0))


def phrases(c: Column) -> Column:
    """Candidate phrases: what stop words, punctuation and digits leave in one piece."""
    t = F.regexp_replace(F.lower(c), r"[^a-z \t\r\n]+", "|")
    t = F.regexp_replace(t, r"\b(?:" + "|".join(STOP_WORDS) + r")\b", "|")
    return F.filter(F.transform(F.split(t, r"\|"), squeeze), lambda p: p != "")


def stripped(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def absolute_url(link: Column, base: str) -> Column:
    """A link as it stands if it has a scheme, else on the host of ``base`` (from ``/``) or in its folder; null and blank stay null."""
    host = "/".join(base.split("/")[:3])
    folder = base.rsplit("/", 1)[0] if base.count("/") > 2 else base
    link = F.nullif(F.trim(link), F.lit(""))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit(base.split(":")[0] + ":"), link))
        .when(link.startswith("/"), F.concat(F.lit(host), link))
        .otherwise(F.concat(F.lit(folder + "/"), link))
    )


def stated_dict(c: Column, schema: str) -> Column:
    """A dictionary written as text with single or double quotes, as a struct or map; unreadable ones are null."""
    return F.from_json(c, schema, {"allowSingleQuotes": "true"})


def mixed_date(c: Column) -> Column:
    """A date in any of the forms year-month-day, month/day/year and month-day-year, of four or two digits of the year; else null."""
    c = F.translate(F.trim(c), "/", "-")
    year = F.regexp_extract(c, r"^\d{1,2}-\d{1,2}-(\d{2}|\d{4})$", 1)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    day = F.concat_ws("-", year, F.regexp_extract(c, r"^(\d{1,2})-", 1), F.regexp_extract(c, r"^\d{1,2}-(\d{1,2})-", 1))
    return F.coalesce(F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c.try_cast("date")), F.when(year != "", day.try_cast("date")))


def first_entity(entities: Column) -> Column:
    """Type of the first of an array of (entity, score), else O."""
    return F.coalesce(F.get(entities, F.lit(0))["entity"], F.lit("O"))


def stated_field(text: Column, value: Column, prefix: str = "latest_", most: int = 4) -> Column:
    """Name of a field told by a text: what is left without the value, its first words in lower case, joined by ``_``."""
    w = F.filter(F.split(F.lower(F.trim(F.replace(text, value, F.lit("")))), r"\s+"), lambda x: x != "")
    return F.concat(F.lit(prefix), F.array_join(F.slice(w, 1, most), "_"))


def without_names(text: Column, names: Column) -> Column:
    """What is left of a text when each of an array of names is removed."""
    return F.trim(F.regexp_replace(F.aggregate(names, text, lambda t, n: F.replace(t, n, F.lit(""))), r"\s+", " "))


def named_columns(df, rename=lambda c: c.strip().lower().replace(" ", "_")):
    """``df`` with its column names in lower case and ``_`` for blanks; names that would clash get a number."""
    out: list[str] = []
    for c in map(rename, df.columns):
        n = sum(x == c or x.rsplit("_", 1)[0] == c and x.rsplit("_", 1)[-1].isdigit() for x in out)
        out.append(f"{c}_{n + 1}" if n else c)
    return df.toDF(*out)
