"""Text, time code and record functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))


def tf(variant: str, count: Column, total: Column, most: Column) -> Column:
    """Term frequency: n (1), p (count), l (ln 1 + count), a (share of all), m (share of the most frequent)."""
    return {"n": F.lit(1.0), "p": count.cast("double"), "l": F.log1p(count), "a": count / total, "m": count / most}[variant]


def idf(variant: str, documents: Column, df: Column) -> Column:
    """Inverse document frequency: n (1), l (ln of documents over df), p (ln of those without over those with, at least 0)."""
    return {"n": F.lit(1.0), "l": F.log(documents / df), "p": F.greatest(F.lit(0.0), F.log(F.greatest(documents - df, F.lit(1)) / df))}[variant]


def char_ngram_bucket(gram: Column) -> Column:
    """One of 256 buckets: the first byte of the gram's md5."""
    return F.conv(F.substring(F.md5(gram.cast("binary")), 1, 2), 16, 10).cast("int")


def timecode(seconds: Column) -> Column:
    """Seconds as H:MM:SS.mmm."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def seconds(code: Column) -> Column:
    """The inverse of timecode."""
    p = F.split(code, "[:.]")
    return F.get(p, F.lit(0)).cast("double") * 3600 + F.get(p, F.lit(1)).cast("double") * 60 + F.get(p, F.lit(2)).cast("double") + F.get(p, F.lit(3)).cast("double") / 1000


def key_values(text: Column) -> Column:
    """`k=v k=v` as a map."""
    return F.str_to_map(text, F.lit(" "), F.lit("="))


def stem(words):
    """The Porter stem of each word of a pandas series."""
    return words.map(porter)


def _measure(w: str) -> int:
    v = "".join("v" if w[i] in "aeiou" or (w[i] == "y" and i and w[i - 1] not in "aeiou") else "c" for i in range(len(w)))
    return sum(a == "v" and b == "c" for a, b in zip(v, v[1:]))


def _vowel(w: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i) for i, c in enumerate(w))


def _short(w: str) -> bool:
    return len(w) > 2 and w[-1] not in "aeiouwxy" and w[-2] in "aeiouy" and w[-3] not in "aeiou"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def porter(word: str | None) -> str | None:
    """Porter's algorithm for English words in lower case."""
    w = word
    if w is None or len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lszaeiou":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for a, b in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(a):
                w = w[: -len(a)] + b if _measure(w[: -len(a)]) else w
                break
    for a in _STEP4:
        if w.endswith(a):
            w = w[: -len(a)] if _measure(w[: -len(a)]) > 1 else w
            break
    else:
        if w.endswith("ion") and len(w) > 3 and w[-4] in "st" and _measure(w[:-3]) > 1:
            w = w[:-3]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def xsd_time(ts: Column) -> Column:
    """A time as xsd:dateTime in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def vtt(seconds: Column) -> Column:
    """Seconds as HH:MM:SS.mmm, as in web subtitles."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def media_duration(seconds: Column) -> Column:
    """Whole seconds as PTxHxMxS."""
    s = seconds.cast("long")
    return F.format_string("PT%dH%dM%dS", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def language_by_words(words: Column, stops: dict[str, list[str]]) -> Column:
    """The language that has most of its stop words among the words, ties to the first by name; null without any."""
    every = sorted({w for ws in stops.values() for w in ws})

    def best(few: Column) -> Column:
        return F.array_min(F.array(*[F.struct((-F.size(F.filter(few, lambda w: w.isin(stops[k])))).alias("n"), F.lit(k).alias("lang")) for k in sorted(stops)]))

    # An argument of a function is computed once, where words would be found anew for each language.
    found = F.transform(F.array(F.filter(words, lambda w: w.isin(every))), best)
    return F.transform(found, lambda b: F.when(b["n"] < 0, b["lang"]))[0]


def word_bag(weights, book):
    """weights (doc_id, term, weight) and book (term, vec) to doc_id, vec: the weighted sum of the vectors of known words."""
    x = weights.join(book, "term").select("doc_id", "weight", F.posexplode("vec").alias("i", "x"))
    s = x.groupBy("doc_id", "i").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    return s.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vec"))
