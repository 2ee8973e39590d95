"""Tokenising, normalising and vectorising text.

Expressions where SQL functions can say it; Arrow functions over batches for
stemming, sentiment, Unicode normal forms and hashing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import settle
from ..errors import EmptyInput, InvalidParameter
from ..operators.joins import join_counted, small

#: Rows whose tokens are counted together.
ROWS = 1024
#: Up to so many classes have columns of their own in naive Bayes.
CLASS_COLUMNS = 32
#: So many tokens are weighed where the rows are read.
WEIGHED = 1 << 15

#: Common English function words.
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being
below between both but by can't cannot could couldn't did didn't do does doesn't doing don't down during
each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers
herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more
most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same
shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them
themselves then there there's these they they'd they'll they're they've this those through to too under
until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which
while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself
yourselves
""".split()


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def regex_tokens(text: Column, pattern: str = r"\w+", gaps: bool = False) -> Column:
    """Matches of a pattern, or what lies between its matches."""
    text = F.coalesce(text, F.lit(""))
    if gaps:
        return F.filter(F.split(text, pattern), lambda t: t != "")
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda t: t != "")


def alnum_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """Joined by spaces: all of the smallest size first."""
    if not 1 <= low <= high:
        raise InvalidParameter("1 <= low <= high is needed")
    made = []
    for n in range(low, high + 1):
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        made.append(F.transform(starts, lambda i, n=n: F.array_join(F.slice(tokens, i, n), " ")) if False else _grams(tokens, starts, n))
    return F.concat(*made)


def _grams(tokens: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def normalize(text: Column, punctuation: bool = True) -> Column:
    """Lower case without punctuation."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_replace(low, r"\p{P}", "") if punctuation else low


def nfc(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return run(text)


def remove_stop_words(tokens: Column, words: Sequence[str] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda t: ~F.lower(t).isin(*words))


def count_tokens(text: Column) -> Column:
    return F.size(whitespace_tokens(text))


def truncate_tokens(text: Column, most: int) -> Column:
    return F.array_join(F.slice(whitespace_tokens(text), 1, most), " ")


# ---- stemming (Porter, 1980) -------------------------------------------------------



def _measure(stem: str) -> int:
    return len(re.findall("VC", re.sub(r"V+", "V", re.sub(r"C+", "C", _shape(stem)))))


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        vowel = c in "aeiou" or c == "y" and i > 0 and out[-1] == "C"
        out += "V" if vowel else "C"
    return out


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "C"


def _cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "CVC" and word[-1] not in "wxy"


#: Suffixes of steps 2, 3 and 4 with their replacements.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter_stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "V" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "V" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                w = w[: -len(end)] + table[end] if _measure(w[: -len(end)]) else w
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stem_text(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}
        return column.map(lambda t: " ".join(memo.get(w) or memo.setdefault(w, porter_stem(w)) for w in (t or "").split()))

    return run(text)


def pos_tag(token: Column) -> Column:
    """Coarse part of speech by suffix rules."""
    low = F.lower(token)
    ends = lambda *x: low.rlike(f"({'|'.join(x)})$")
    return (
        F.when(low.isin("the", "a", "an", "this", "that", "these", "those"), "Determiner")
        .when(low.isin("and", "or", "but", "nor", "yet", "so"), "Conjunction")
        .when(low.isin("in", "on", "at", "by", "for", "with", "from", "to", "of"), "Preposition")
        .when(low.isin("he", "she", "it", "they", "we", "you", "i"), "Pronoun")
        .when(low.rlike(r"^[0-9.,]+$"), "Number")
        .when(ends("ly"), "Adverb")
        .when(ends("ing", "ed", "ize", "ise"), "Verb")
        .when(ends("ous", "ful", "able", "ible", "ive", "al", "ic"), "Adjective")
        .otherwise("Noun")
    )


# ---- sentiment (Hutto and Gilbert's rules, 2014) ------------------------------------

#: A small valence lexicon.
LEXICON = {
    "good": 1.9, "great": 3.1, "excellent": 2.7, "love": 3.2, "loved": 2.9, "like": 1.5, "fantastic": 2.6, "wonderful": 2.7, "happy": 2.7, "best": 3.2, "nice": 1.8, "amazing": 2.8, "awesome": 3.1, "perfect": 2.7, "beautiful": 2.9, "enjoy": 2.2, "fun": 2.3, "win": 2.8, "helpful": 1.8, "easy": 1.9,
    "bad": -2.5, "terrible": -2.1, "awful": -2.0, "hate": -2.7, "horrible": -2.5, "worst": -3.1, "poor": -2.1, "sad": -2.1, "angry": -2.3, "ugly": -2.3, "broken": -2.1, "boring": -1.3, "fail": -2.5, "wrong": -2.1, "pain": -2.3, "problem": -1.7, "stupid": -2.4, "idiot": -2.3, "disgusting": -2.4, "pathetic": -2.7, "worthless": -1.9, "trash": -1.5, "loser": -2.4, "moron": -2.2, "scum": -2.5,
}
BOOSTERS = {"very": 0.293, "really": 0.293, "extremely": 0.293, "absolutely": 0.293, "so": 0.293, "incredibly": 0.293, "slightly": -0.293, "somewhat": -0.293, "barely": -0.293, "kind": -0.293}
NEGATIONS = {"not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "cannot", "can't", "don't", "won't", "isn't", "wasn't", "without"}


def sentiment_scores(text: str, lexicon: dict[str, float] = LEXICON) -> tuple[float, float, float, float]:
    """(negative, neutral, positive, compound)."""
    raw = text.split()
    tokens = [t.strip(".,!?;:\"()").lower() for t in raw]
    mixed = any(t.isupper() for t in raw) and not all(t.isupper() for t in raw)
    values = []
    for i, t in enumerate(tokens):
        v = lexicon.get(t, 0.0)
        if v:
            sign = 1 if v > 0 else -1
            if raw[i].isupper() and mixed:
                v += sign * 0.733
            for back in range(1, 4):
                if i >= back:
                    before = tokens[i - back]
                    v += sign * BOOSTERS.get(before, 0.0) * (1, 0.95, 0.9)[back - 1]
                    if before in NEGATIONS:
                        v *= -0.74
        values.append(v)
    total = sum(values)
    marks = min(0.293 * text.count("!"), 0.96)
    total += marks if total > 0 else -marks if total < 0 else 0
    pos, neg, neu = sum(v + 1 for v in values if v > 0), sum(-v + 1 for v in values if v < 0), sum(v == 0 for v in values)
    whole = (pos + neg + neu) or 1
    return neg / whole, neu / whole, pos / whole, total / math.sqrt(total * total + 15)


def sentiment(text: Column) -> Column:
    @F.pandas_udf("struct<neg:double,neu:double,pos:double,compound:double>")
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sentiment_scores(t or "") for t in column], columns=["neg", "neu", "pos", "compound"])

    return run(text)


# ---- vectorisers --------------------------------------------------------------------


def counted(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """(keys, len, token, n): the different tokens of each row with their numbers
    and the row's number of tokens, counted where the row is, without a shuffle."""
    rows = df.select(*[F.col(f"`{k}`") for k in keys], tokens.alias("_tokens")).where(F.size("_tokens") > 0)
    names = [*keys, "len", "token", "n"]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("len", T.LongType()), T.StructField("token", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                lists = batch.column(len(keys))
                size = lists.value_lengths().to_numpy(zero_copy_only=False)
                row, code, n, words = _coded(lists)
                taken = pa.array(row)
                columns = [batch.column(k).take(taken) for k in range(len(keys))]
                known = pa.array(code, mask=code == len(words))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(size[row].astype(np.int64)), words.take(known), pa.array(n.astype(np.int64))], names=names)

    return rows.mapInArrow(run, schema)


def totalled(df: DataFrame, tokens: Column, label: str) -> DataFrame:
    """(label, token, n, df): numbers of tokens, and of rows that have them, by
    label; several rows of a label and token are still to be added up."""
    rows = df.select(F.col(f"`{label}`").alias("label"), tokens.alias("_tokens")).where(F.size("_tokens") > 0)
    schema = T.StructType([rows.schema["label"], T.StructField("token", T.StringType()), T.StructField("n", T.LongType()), T.StructField("df", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                row, code, n, words = _coded(batch.column(1))
                labels = batch.column(0).dictionary_encode()
                label = labels.indices.fill_null(len(labels.dictionary)).to_numpy()[row].astype(np.int64)
                both, at_both = np.unique(label * (len(words) + 1) + code, return_inverse=True)
                label, code = np.divmod(both, len(words) + 1)
                totals = [np.bincount(at_both, w, len(both)).astype(np.int64) for w in (n, None)]
                taken = [pool.take(pa.array(k, mask=k == len(pool))) for pool, k in ((labels.dictionary, label), (words, code))]
                yield pa.RecordBatch.from_arrays([*taken, *map(pa.array, totals)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, n) of the different tokens of each row, and the tokens by code;
    the code after the last is null."""
    coded = lists.flatten().dictionary_encode()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    row, code = np.repeat(np.arange(len(size)), size), coded.indices.fill_null(len(coded.dictionary)).to_numpy()
    both, n = np.unique(row * (len(coded.dictionary) + 1) + code, return_counts=True)
    return *np.divmod(both, len(coded.dictionary) + 1), n, coded.dictionary


def _is_unique(df: DataFrame, key: str) -> bool:
    """Whether no key occurs twice: rows can be counted on their own then."""
    return df.groupBy(F.col(f"`{key}`")).count().where("count > 1").limit(1).count() == 0


def _by_key(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, len, token, n) with a row for each key and token."""
    rows = counted(df, tokens, key)
    if _is_unique(df, key):
        return rows
    return rows.groupBy(key, "len", "token").agg(F.sum("n").alias("n"))


def vocabulary(df: DataFrame, tokens: str, max_features: int | None = None, min_df: int = 1) -> DataFrame:
    """(token, count, df), the most frequent first and ties by token."""
    counts = counted(df, F.col(tokens)).groupBy("token").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("df"))
    counts = counts.where(F.col("df") >= min_df)
    return counts.orderBy(F.desc("count"), "token").limit(max_features) if max_features else counts


def count_vectors(df: DataFrame, key: str, tokens: Column, max_features: int | None = None) -> DataFrame:
    """(key, token, tf) of the vocabulary's tokens, in sparse long form."""
    counts = counted(df, tokens, key)
    if not _is_unique(df, key):
        counts = counts.groupBy(key, "token").agg(F.sum("n").alias("n"))
    if max_features:
        top = vocabulary(df.select(tokens.alias("_tokens")), "_tokens", max_features)
        counts = join_counted(counts, top.select("token", "df"), ["token"], "df")
    return counts.select(key, "token", F.col("n").alias("tf"))


def tfidf(df: DataFrame, key: str, tokens: Column, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """(key, token, tfidf): tf is the share of the document's tokens, idf is
    ln((1 + N) / (1 + df)) + 1. ``max_features`` keeps the tokens of most
    documents, ties by token. Rows of one key and one number of tokens are one
    document. Only the tokens' frequencies move, and what has a token of a large
    vocabulary that isn't common."""
    n = df.count()
    counts = _by_key(df, key, tokens)
    seen = counts.groupBy("token").agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df") >= min_df)
    if max_features is not None:
        seen = seen.orderBy(F.desc("_df"), "token").limit(max_features)
    seen = settle(seen)
    idf = F.log((1.0 + n) / (1.0 + F.col("_df"))) + 1
    return join_counted(counts, seen, ["token"], "_df").select(key, "token", (F.col("n") / F.col("len") * idf).alias("tfidf"))


def fnv1a(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def hashing_vector(tokens: Column, size: int = 1024) -> Column:
    """Counts of FNV-1a hashed tokens."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        memo: dict[str, int] = {}

        def one(words) -> np.ndarray:
            out = np.zeros(size)
            for w in words if words is not None else ():
                k = memo.get(w)
                if k is None:
                    k = memo[w] = fnv1a(w) % size
                out[k] += 1
            return out

        return column.map(one)

    return run(tokens)


def local_embedding(text: Column, size: int = 256) -> Column:
    """Signed hashing of words (weight 2) and of character 3- to 5-grams
    (weight 1), of length 1."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        def one(t: str | None) -> np.ndarray:
            out = np.zeros(size)
            for w in (t or "").lower().split():
                parts = [(w, 2.0)] + [(w[i : i + n], 1.0) for n in (3, 4, 5) for i in range(len(w) - n + 1)]
                for part, weight in parts:
                    h = fnv1a(part)
                    out[h % size] += weight if h >> 63 else -weight
            length = np.sqrt((out * out).sum())
            return out / length if length else out

        return column.map(one)

    return run(text)


# ---- naive Bayes ---------------------------------------------------------------------


@dataclass
class NaiveBayes:
    """A class's weight of a token is ``base`` of the token plus ``rest`` of the
    class, plus a correction where the class has seen it, over ``norm`` of the
    class; so what is stored is a row for each token, with the corrections of the
    classes that have it, and one for each class."""

    tokens: DataFrame  # (token, base, df, seen array<struct<label, w>>)
    classes: DataFrame  # (label, prior, rest, norm)


def naive_bayes(train: DataFrame, label: str, tokens: str, alpha: float = 1.0, complement: bool = False) -> NaiveBayes:
    """Multinomial weights ln((n + alpha) / (total + alpha * V)); the complement
    variant has L1-normalised weights of the other classes."""
    if alpha <= 0:
        raise InvalidParameter("alpha must be above 0")
    docs = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("docs"))
    pairs = totalled(train, F.col(tokens), label).groupBy("token", "label").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    by_token = settle(pairs.groupBy("token").agg(F.sum("n").alias("all"), F.sum("df").alias("df"), F.collect_list(F.struct("label", "n")).alias("in")))  # a pair for each class at most
    if complement:
        base = F.log(F.col("all") + alpha)
        correction = lambda n: F.log((F.col("all") - n + alpha) / (F.col("all") + alpha))
    else:
        base = F.lit(0.0)
        correction = lambda n: F.log((n + alpha) / F.lit(float(alpha)))
    seen = F.transform("in", lambda p: F.struct(p["label"].alias("label"), correction(p["n"]).alias("w")))
    words = by_token.select("token", base.alias("base"), "df", seen.alias("seen"))
    size, whole, bases = by_token.agg(F.count(F.lit(1)), F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum(base), F.lit(0.0))).first()
    sums = by_token.select("all", F.explode("in").alias("p")).select("all", "p.label", "p.n").groupBy("label").agg(F.sum("n").alias("total"), F.sum(correction(F.col("n"))).alias("corrections"))
    joined = docs.join(sums, docs["label"].eqNullSafe(sums["label"]), "left").select(docs["label"], "docs", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("corrections", F.lit(0.0)).alias("corrections"))
    every = joined.agg(F.sum("docs")).first()[0] or 0
    others = F.lit(whole) - F.col("total") if complement else F.col("total")
    rest = (F.lit(0.0) if complement else F.log(F.lit(float(alpha)))) - F.log(others + F.lit(float(alpha * size)))
    norm = -(F.lit(float(size)) * rest + F.lit(float(bases)) + F.col("corrections")) if complement else F.lit(1.0)
    classes = joined.select("label", F.log(F.col("docs") / F.lit(every)).alias("prior"), rest.alias("rest"), norm.alias("norm"))
    return NaiveBayes(words, settle(classes))


def naive_bayes_predict(df: DataFrame, key: str, tokens: str, model: NaiveBayes, label: str, complement: bool = False) -> DataFrame:
    """(key, label): the best class; ties go to the smallest label. Tokens that
    training hasn't seen don't count."""
    classes = model.classes.collect()  # a row for each class
    if not classes:
        raise EmptyInput(label)
    words = model.tokens
    weight_of = lambda seen, c: F.coalesce(F.get(F.filter(seen, lambda p: p["label"].eqNullSafe(F.lit(c["label"]))), F.lit(0))["w"], F.lit(0.0))
    if len(classes) <= CLASS_COLUMNS:
        words = words.select("token", "base", "df", *[weight_of("seen", c).alias(f"_w{k}") for k, c in enumerate(classes)])
        own = [F.coalesce(F.col(f"_w{k}"), F.lit(0.0)) for k in range(len(classes))]
        sums = _weighed(df, tokens, key, words, ["base", *[f"_w{k}" for k in range(len(classes))]]).withColumnRenamed("base", "bases")
    else:
        found = join_counted(counted(df, F.col(tokens), key), words, ["token"], "df").select(key, "n", "base", F.posexplode("seen").alias("at", "s"))  # a token has been seen in some class
        once = lambda x: F.sum(F.when(F.col("at") == 0, x))
        parts = found.groupBy(key, F.col("s.label").alias("label")).agg(F.sum(F.col("n") * F.col("s.w")).alias("w"), once(F.col("n")).alias("known"), once(F.col("n") * F.col("base")).alias("bases"))
        sums = parts.groupBy(key).agg(F.sum("known").alias("known"), F.sum("bases").alias("bases"), F.collect_list(F.struct("label", "w")).alias("parts"))
        own = [weight_of("parts", c) for c in classes]
    every = df.select(F.struct(key).alias("_key")).distinct()
    every = every.join(sums, F.col(f"_key.{key}").eqNullSafe(sums[key]), "left").drop(key)
    scored = []
    for c, part in zip(classes, own, strict=True):
        s = (F.coalesce("bases", F.lit(0.0)) + F.coalesce("known", F.lit(0)) * F.lit(c["rest"]) + part) / F.lit(c["norm"])
        scored.append(F.struct((s if complement else -(s + F.lit(c["prior"]))).alias("minus"), F.lit(c["label"]).alias("label")))
    return every.select(f"_key.{key}", F.array_min(F.array(*scored))["label"].alias(label))


def _weighed(df: DataFrame, tokens: str, key: str, words: DataFrame, weights: list[str]) -> DataFrame:
    """(key, known, weights): the number of tokens that ``words`` has, and totals of
    their weights. The most common tokens, a bounded number of them and of their
    bytes, are weighed where the rows are read; only the others meet their weights by
    a shuffle. So rows are tokenised once, and what they mostly hold doesn't move."""
    n = F.col("n")
    if small(words):
        found = counted(df, F.col(tokens), key).join(F.broadcast(words), "token")
        return found.groupBy(key).agg(F.sum("n").alias("known"), *[F.sum(n * F.col(w)).alias(w) for w in weights])
    short = F.octet_length("token") <= F.lit(256)
    top = words.where(short).select("df").orderBy(F.desc("df")).limit(WEIGHED + 1).collect()
    common = short & (F.col("df") > F.lit(top[WEIGHED]["df"] if len(top) > WEIGHED else 0))
    most = words.where(common).select("token", *weights).collect()  # WEIGHED rows at most
    shared = df.sparkSession.sparkContext.broadcast(([r["token"] for r in most], np.array([[1.0, *r[1:]] for r in most]).reshape(len(most), 1 + len(weights))))
    rows = df.select(F.col(f"`{key}`"), F.col(f"`{tokens}`").alias("_tokens")).where(F.size("_tokens") > 0)
    sums = ["known", *weights]
    schema = T.StructType([rows.schema.fields[0], T.StructField("token", T.StringType()), T.StructField("n", T.LongType()), *[T.StructField(f"_{w}", T.DoubleType()) for w in sums]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight = pa.array(shared.value[0], pa.string()), shared.value[1]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                row, code, n, found = _coded(batch.column(1))
                place = np.append(pc.index_in(found, value_set=names).fill_null(-1).to_numpy(), -1)[code]  # nulls have no weight
                is_common, is_rest = place >= 0, (place < 0) & (code < len(found))
                totals = [np.bincount(row[is_common], n[is_common] * weight[place[is_common], k], batch.num_rows).astype(float) for k in range(len(sums))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(batch.num_rows, pa.string()), pa.array(np.zeros(batch.num_rows, np.int64)), *map(pa.array, totals)], names=schema.names)
                k = int(is_rest.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[is_rest])), found.take(pa.array(code[is_rest])), pa.array(n[is_rest].astype(np.int64)), *[pa.array(np.zeros(k))] * len(sums)], names=schema.names)

    # rows of totals have no token: they are dealt out by key, and meet nothing
    salt = F.when(F.col("token").isNull(), F.pmod(F.xxhash64(key), F.lit(1024)).cast("int")).otherwise(-1)
    left = rows.mapInArrow(run, schema).withColumn("_salt", salt).withColumn("token", F.coalesce("token", F.lit("")))
    found = left.join(words.where(~common).withColumn("_salt", F.lit(-1)), ["token", "_salt"], "left")
    known = (F.sum("_known").cast("long") + F.sum(F.when(F.col("df").isNotNull(), n).otherwise(0))).alias("known")
    return found.groupBy(key).agg(known, *[F.sum(F.col(f"_{w}") + F.coalesce(n * F.col(w), F.lit(0.0))).alias(w) for w in weights])


#: Function words of languages.
PROFILES = {
    "de": "der die das und ist nicht ein eine zu mit von auf".split(),
    "en": "the and of to in is that it for was with".split(),
    "es": "el los las que una por con para del es en y".split(),
    "fr": "le la les et des une est dans que pour pas du".split(),
}


def detect_language(text: Column, profiles: dict[str, Sequence[str]] | None = None) -> Column:
    """The language with most function words in the text; ties by name."""
    profiles = profiles or PROFILES
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")
    scored = [F.struct(F.size(_hits(tokens, w)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("lang")) for k, (name, w) in enumerate(sorted(profiles.items()))]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["lang"])


def _hits(tokens: Column, words: Sequence[str]) -> Column:
    return F.filter(tokens, lambda t: t.isin(*words))
