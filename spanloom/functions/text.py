"""Tokenizers and string functions as Spark columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII = "[A-Za-z0-9]+"
XML = r"</?[A-Za-z_][A-Za-z0-9_.\-]*[^\n>]*>|&[^ \n;]*;|[A-Za-z0-9]+"
_IDEO = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{17000}-\x{187F7}\x{18D00}-\x{18D08}\x{20000}-\x{323AF}"
UTF8 = rf"[{_IDEO}\x{{FDD0}}-\x{{FDEF}}]|\p{{So}}|[\p{{L}}\p{{M}}\p{{N}}&&[^{_IDEO}]]+"
TRUTHY = sorted({f for w in ("y", "yes", "on", "true", "okay", "ok") for f in (w, w.capitalize())} | {"OK"})


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def inner_capital(word: Column) -> Column:
    """Whether a character of an ASCII word after the first is a capital: such words also keep their own spelling."""
    rest = F.substring(word, 2, 1 << 30)
    return rest != F.lower(rest)  # a fraction of what a pattern takes


def ascii_words(text: Column) -> Column:
    return _all(text, ASCII)


def ascii_split(text: Column) -> Column:
    """Words in lower case, but those with inner capitals as they stand."""
    return F.transform(ascii_words(text), lambda w: F.when(inner_capital(w), w).otherwise(F.lower(w)))


def ascii_features(word: Column) -> Column:
    """The features of one word: its lower-case form, and its own where it has inner capitals."""
    return F.when(inner_capital(word), F.array(word, F.lower(word))).otherwise(F.array(F.lower(word)))


def _starts(ordered: Column, key) -> Column:
    """Places, from 1, of an ordered array at which another key begins."""
    at = F.sequence(F.lit(1), F.size(ordered))
    fresh = F.filter(at, lambda i: (i == 1) | (key(F.get(ordered, i - 1)) != key(F.get(ordered, i - 2))))
    return F.when(F.size(ordered) > 0, fresh)


def runs(rows: DataFrame, ordered: str, key, make) -> DataFrame:
    """rows, once for each run of equal keys in the array `ordered`, which is replaced by the fields of make(array, the run's place from 1, its length).

    A row's runs are found within the row: nothing is shuffled or held beyond a
    row.  Each step names what it takes from the one before more than once, so
    that Spark doesn't compute that again for every element.
    """
    rest = [c for c in rows.columns if c != ordered]
    every = F.col(ordered)
    placed = rows.withColumn("_at", _starts(every, key))
    each = F.transform("_at", lambda a, j: make(every, a, F.coalesce(F.get("_at", j + 1), F.size(every) + 1) - a))
    return placed.select(*rest, F.explode(each).alias("_run")).select(*rest, "_run.*")


def counted(rows: DataFrame, words: str, name: str, n: str) -> DataFrame:
    """rows, once for each distinct word of the array `words`, with the word as `name` and how often it stands there as `n`."""
    ordered = rows.withColumn(words, F.sort_array(words))
    return runs(ordered, words, lambda w: w, lambda ws, at, size: F.struct(F.get(ws, at - 1).alias(name), size.cast("long").alias(n)))


def xml_split(text: Column) -> Column:
    """Tags (without attributes) and words of markup; entities are skipped."""
    found = F.filter(_all(text, XML), lambda s: ~s.startswith("&"))
    tag = lambda s: F.concat(F.regexp_extract(s, r"^</?[A-Za-z0-9_.\-]+", 0), F.lit(">"))
    return F.transform(found, lambda s: F.when(s.startswith("<"), tag(s)).when(inner_capital(s), s).otherwise(F.lower(s)))


def utf8_split(text: Column) -> Column:
    """Folded runs of letters, marks and numbers; symbols and ideographs stand alone."""
    return F.transform(_all(text, UTF8), F.lower)


TOKENIZERS = {"ascii": ascii_split, "xml": xml_split, "utf8": utf8_split}


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, pos, feature): every feature of every ASCII word; variants share a position."""
    words = docs.select(F.col(id_col).alias("doc"), F.posexplode(ascii_words(F.col(text_col))).alias("pos", "word"))
    return words.select("doc", F.col("pos").cast("long").alias("pos"), F.explode(ascii_features(F.col("word"))).alias("feature"))


def skip_words(text: Column, n: int) -> Column:
    """The text from the start of its n-th ASCII word (0 is the first) on; empty when there are fewer."""
    return F.when(F.size(ascii_words(text)) <= n, "").otherwise(F.regexp_replace(text, rf"^(?s:(?:[^A-Za-z0-9]*[A-Za-z0-9]+(?![A-Za-z0-9])){{{n}}}[^A-Za-z0-9]*)", ""))


def translate(text: Column, p: int, q: int) -> Column:
    """Characters from the start of word p up to the start of word q + 1, separators included."""
    return F.regexp_extract(text, rf"^(?s:(?:[^A-Za-z0-9]*[A-Za-z0-9]+(?![A-Za-z0-9])){{{p}}}[^A-Za-z0-9]*)((?s:(?:[A-Za-z0-9]+(?![A-Za-z0-9])[^A-Za-z0-9]*){{{q - p + 1}}}))", 1)


def docno(s: Column) -> Column:
    """A document number without its tags, quotes and surrounding white space."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(s, "</?DOCNO>", " "), r"\S+", 0), '"', "")


def split_lines(s: Column) -> Column:
    return F.split(s, "\r\n|\r|\n")


def split_tsv(s: Column, sep: str = "\t") -> Column:
    """Fields of a line; an empty separator means runs of white space."""
    if sep:
        return F.split(s, "\\Q" + sep + "\\E")
    return F.filter(F.split(s, r"\s+"), lambda x: x != "")


def textual_date(s: Column) -> Column:
    """The date of a time as text: 2012-11-20T20:02:24.386Z (any offset), Feb 20 2015, milliseconds since 1970, Fri May 25 19:30:28 UTC 2007; null for others and before 1970."""
    day = lambda text, form: F.try_to_timestamp(text, F.lit(form)).cast("date")
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), day(F.substring(s, 1, 10), "yyyy-MM-dd"))
    words = r"^(?:[A-Z][a-z]{2} )?([A-Z][a-z]{2}) +(\d{1,2})(?: \d{2}:\d{2}:\d{2} [A-Z]+)? (\d{4})$"
    named = F.when(s.rlike(words), day(F.concat_ws(" ", F.regexp_extract(s, words, 1), F.regexp_extract(s, words, 2), F.regexp_extract(s, words, 3)), "MMM d yyyy"))
    number = F.when(s.rlike(r"^\d{1,15}$"), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s.cast("long") / 86_400_000).cast("int")))
    found = F.coalesce(iso, named, number)
    return F.when(found >= "1970-01-01", found)


def normal_path(s: Column) -> Column:
    return F.when(s.contains("/"), s).otherwise(F.concat(F.lit("./"), s))


def okay(s: Column) -> Column:
    return s.isin(TRUTHY)
