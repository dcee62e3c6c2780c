"""Problem 3: one consistent form in which what looks the same is equal.

Script-aware repair: the dominant script of each token is determined, and look-alikes are substituted in tokens that mix
scripts when the result exists in the corpus vocabulary (all words of the three fields). Two additions, as looking the same
decides here: a token made of look-alikes only is treated like a mixed one, and a token without an entry in the vocabulary
is read as Latin when all its foreign letters are look-alikes and Latin dominates its text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sizelake.functions.unicode_forms import DIRTY, FOREIGN, GREEK_IN_WORDS, as_cyrillic, as_greek, as_latin, base_form, script
from sizelake.session import cut

#: A token: a run of letters and marks that holds a letter of another script.
_TOKEN = rf"[\p{{L}}\p{{M}}]*{FOREIGN}[\p{{L}}\p{{M}}]*"
FIELDS = ("elements.text", "gia_tri_so.cau_chua", "nhan_xet_dinh_tinh.trich_dan_tai_lieu")


_DIRTY_RE = re.compile(DIRTY)
_FOREIGN_RE = re.compile(FOREIGN)
_NOT_LATIN = re.compile(r"[^A-Za-z\u00c0-\u024f\u1e00-\u1eff]+")
_WORD = re.compile(r"[^\W\d_]+")
FORM = T.StructType([T.StructField("base", T.StringType()), T.StructField("latin_text", T.BooleanType())])


def _formed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """base where it differs from the text or holds a foreign letter; latin_text only for the latter."""
    for s in texts:
        base, latin = [], []
        for t in s:
            b = l = None
            if t is not None and not t.isascii() and _DIRTY_RE.search(t):
                b = base_form(t)
                if n := len(_FOREIGN_RE.findall(b)):
                    l = len(_NOT_LATIN.sub("", b)) > n
            base.append(b)
            latin.append(l)
        yield pd.DataFrame({"base": base, "latin_text": latin}).astype({"base": object, "latin_text": object})


def _words_of(tokens: set[str]) -> set[str]:
    """The words, lower case and certainly of one script, in blank-separated tokens."""
    out: set[str] = set()
    for t in tokens:
        if t.isascii():
            out.update(_WORD.findall(t.lower()))
            continue
        t = base_form(t)
        words = _WORD.findall(t)
        if _FOREIGN_RE.search(t):
            # words of two scripts are no evidence, nor are those that might be either
            words = [w for w in words if not _FOREIGN_RE.search(w) or (len({script(c) for c in unicodedata.normalize("NFD", w)} - {""}) == 1 and _FOREIGN_RE.search(as_latin(w)))]
        out.update(w.lower() for w in words)
    return out


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct words of a partition, a part of them at a time. Texts are only parted at blanks (of any kind); forms and
    scripts are looked at once for each distinct token."""
    tokens: set[str] = set()
    for pdf in batches:
        for t in pdf["text"]:
            if t is not None:
                tokens.update(t.split())
        if len(tokens) > 200_000:
            yield pd.DataFrame({"word": list(_words_of(tokens))}, dtype=object)
            tokens.clear()
    yield pd.DataFrame({"word": list(_words_of(tokens))}, dtype=object)


def readings(token: str) -> list[str]:
    """The token in the scripts it could be written in, the dominant script first. Letters with a twin in the other script
    count for neither; a token of such letters only is taken for Latin first."""
    letters = unicodedata.normalize("NFD", token)
    if len(token) == 1 and token in GREEK_IN_WORDS:
        return [token]  # a symbol, such as a coefficient: nobody takes it for a word
    n: dict[str, int] = {}
    for c in letters:
        sc = script(c)
        if not sc:
            continue
        twin = as_latin(c) != c if sc != "latin" else (as_cyrillic(c) != c or as_greek(c) != c)
        if not twin:
            n[sc] = n.get(sc, 0) + 1
    order = sorted(("latin", "cyrillic", "greek"), key=lambda k: -n.get(k, 0))
    out = []
    for sc in order:
        r = {"latin": as_latin, "cyrillic": as_cyrillic, "greek": as_greek}[sc](token)
        if len({script(c) for c in unicodedata.normalize("NFD", r)} - {""}) == 1 and r not in out:
            out.append(r)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _readings(tokens: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else readings(t) for t in tokens], dtype=object)


def vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word): every word, lower case, that is written in one script in some text. Each partition gives its words once."""
    return texts.select(F.col(text).alias("text")).mapInPandas(_words, "word string").distinct()


def repairs(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, latin_text, fixed): what each suspicious token becomes."""
    tokens = tokens.select("latin_text", "token").distinct()
    tried = tokens.withColumn("r", _readings("token")).select("latin_text", "token", F.posexplode("r").alias("rank", "reading"))
    known = tried.withColumn("word", F.lower("reading")).join(words.withColumn("known", F.lit(True)), "word", "left")
    latin_only = ~F.col("reading").rlike(FOREIGN)
    ok = F.col("known").isNotNull()
    return known.groupBy("token", "latin_text").agg(
        F.min(F.when(ok, F.struct("rank", "reading"))).alias("by_vocabulary"),
        F.min(F.when(latin_only & F.col("latin_text"), F.struct("rank", "reading"))).alias("by_look"),
    ).select("token", "latin_text", F.coalesce("by_vocabulary.reading", "by_look.reading", "token").alias("fixed")).where("fixed <> token")


@F.pandas_udf(T.StringType())
def _replaced(texts: pd.Series, fixes: pd.Series) -> pd.Series:
    token = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")

    def one(t, pairs):
        if t is None or pairs is None or len(pairs) == 0:
            return t
        m = {p["token"]: p["fixed"] for p in pairs}
        return unicodedata.normalize("NFC", token.sub(lambda x: m.get(x.group(), x.group()), t))

    return pd.Series([one(t, p) for t, p in zip(texts, fixes, strict=True)], dtype=object)


def _prepared(df: DataFrame, text: str) -> DataFrame:
    # not deterministic as far as the optimiser knows, or it would evaluate the function again for each filter on its result
    formed = F.pandas_udf(_formed, FORM).asNondeterministic()
    return df.withColumn("__f", formed(F.col(text)))


def consistent_text(df: DataFrame, text: str = "text", words: DataFrame | None = None) -> DataFrame:
    """df with a column `form`, the consistent form of `text`.

    The vocabulary is that of df, or `words` (word). Null text has form null, empty text the empty form; texts of any length
    are taken whole; repeated rows are kept; an empty table gives an empty one. Columns of df may have any name; a column
    called form is replaced, unless it is the text itself. Texts without foreign letters take one pass; the others, few as a rule, are
    written to the shared folder and joined with the repairs of their tokens."""
    keep = [c for c in df.columns if c != "form"]
    own = df.select(F.struct(*keep).alias("row") if keep else F.struct(F.lit(1).alias("_")).alias("row"), F.col(text).alias("text"))
    p = _prepared(own, "text")
    foreign = F.col("__f.latin_text").isNotNull()
    plain = p.where(~foreign).select("row", F.coalesce("__f.base", "text").alias("form"))
    mixed = cut(p.where(foreign).select("row", F.col("__f.base").alias("base"), F.col("__f.latin_text").alias("latin_text"), F.xxhash64("__f.base").alias("k1"), F.xxhash64(F.lit("2"), "__f.base").alias("k2")))
    tokens = cut(mixed.select("k1", "k2", "latin_text", F.explode(F.array_distinct(F.regexp_extract_all("base", F.lit(f"({_TOKEN})"), 1))).alias("token")).distinct())
    words = vocabulary(df, text) if words is None else words
    fixes = tokens.join(repairs(tokens, words), ["token", "latin_text"]).groupBy("k1", "k2").agg(
        F.collect_list(F.struct("token", "fixed")).alias("fixes")  # the tokens of one text
    )
    repaired = mixed.join(fixes, ["k1", "k2"], "left").select("row", _replaced("base", "fixes").alias("form"))
    return plain.unionByName(repaired).select(*(["row.*"] if keep else []), "form")


def _texts(spark, folder: str) -> DataFrame:
    """(field, record_id, doc_id, element_index, text) of the three fields, rows repeated exactly once."""
    from sizelake.sources.tables import table

    e = table(spark, folder, "elements").select(F.lit("text").alias("field"), F.lit(None).cast("long").alias("record_id"), "doc_id", "element_index", "text")
    g = table(spark, folder, "gia_tri_so").select(F.lit("cau_chua").alias("field"), F.col("value_id").alias("record_id"), "doc_id", F.lit(None).cast("int").alias("element_index"), F.col("cau_chua").alias("text"))
    n = table(spark, folder, "nhan_xet_dinh_tinh").select(F.lit("trich_dan_tai_lieu").alias("field"), F.col("nhan_xet_id").alias("record_id"), "doc_id", F.lit(None).cast("int").alias("element_index"), F.col("trich_dan_tai_lieu").alias("text"))
    return e.unionByName(g).unionByName(n).where(F.col("text") != "")


def lookalike_pairs(formed: DataFrame) -> DataFrame:
    """(field, record_id, doc_id, element_index): quotes and elements of one document whose forms are equal and whose
    strings are not. formed has the columns of _texts and form. Only hashes (128 bits) of forms and strings are shuffled;
    null documents match nothing; rows repeated exactly count once."""
    h = formed.where((F.col("form") != "") & F.col("doc_id").isNotNull()).select(
        "field", "record_id", "doc_id", "element_index",
        F.xxhash64("form").alias("f1"), F.xxhash64(F.lit("2"), "form").alias("f2"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("2"), "text").alias("t2"),
    )
    e = h.where("field = 'text'").select("doc_id", "element_index", "f1", "f2", F.col("t1").alias("e1"), F.col("t2").alias("e2")).distinct()
    q = h.where("field <> 'text'").drop("element_index").distinct()
    return (
        q.join(e, ["doc_id", "f1", "f2"])
        .where((F.col("t1") != F.col("e1")) | (F.col("t2") != F.col("e2")))
        .select("field", "record_id", "doc_id", "element_index")
        .distinct()
    )


def p3_found(spark, folder: str) -> DataFrame:
    return lookalike_pairs(consistent_text(_texts(spark, folder)))


def p3_forms(spark, folder: str) -> DataFrame:
    """Every text of the three fields in its consistent form."""
    return consistent_text(_texts(spark, folder)).select("field", "record_id", "doc_id", "element_index", "form")
