"""TF-IDF over unigrams and bigrams as row-local sparse vectors.

Semantics follow the usual vectoriser defaults: lower-case, tokens are runs of
two or more letters, digits or underscores, bigrams join adjacent tokens with
one space, the vocabulary is the ``max_features`` terms with the highest corpus
count (ties by term), idf = ln((1 + n) / (1 + df)) + 1, weights tf * idf and
L2-normalised per row over the vocabulary.

Layout at scale. Transforming shuffles nothing: the capped vocabulary travels as a
dictionary, and every row turns its own text into ``array<struct<term_id, weight>>``.

Fitting finds the most frequent terms without an aggregate over all distinct terms,
most of which are bigrams that occur once. Each task feeds its terms to a mergeable
frequent-items sketch of bounded size; the merged sketch names a few candidates and a
second pass counts those exactly. The sketch never underestimates, and it tracks no
term whose count it could overestimate by more than its smallest estimate. So when the
``max_features``-th exact count is above the smallest candidate's estimate, no other term
can be among the most frequent (``certified``). When it is not, the exact aggregate
over all terms decides; so the vocabulary is the same either way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
TRACKED = 1 << 17       # terms a sketch tracks at most: its size, whatever the corpus
CANDIDATES = 3          # candidates counted exactly, per term of the vocabulary
SKETCH_GROUPS = 64      # sketches of tasks are merged in so many groups before the last merge
SPARSE = "array<struct<term_id:int,weight:double>>"


def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    # possessive, as no token gives a character back: the matcher keeps no way back
    return F.regexp_extract_all(F.lower(t), F.lit(f"({TOKEN_PATTERN}+)"), 1)


def terms(text) -> Column:
    """Unigrams followed by bigrams of one text."""
    def both(toks: Column) -> Column:
        nxt = F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0)))
        return F.concat(toks, F.transform(nxt, lambda b, i: F.concat(F.get(toks, i), F.lit(" "), b)))
    return let(tokens(text), both)


def one_by_one(array: Column, name: str) -> Column:
    """Explode without the filter on a non-empty array that the optimiser would infer, and
    compute ``array`` for, below every exchange; empty arrays give one null, to be left out."""
    return F.explode_outer(array).alias(name)


@dataclass
class TfidfModel:
    vocab: DataFrame        # term, df, idf, term_id (at most max_features rows)
    n_docs: int
    max_features: int
    entries: list[tuple[str, float]] = field(repr=False, default_factory=list)  # term, idf by term_id


def term_stats(corpus: DataFrame, terms_col: str) -> DataFrame:
    """``term``, ``total``, ``df`` of every distinct term: one partially aggregated shuffle."""
    marks = let(F.col(terms_col), lambda t: F.concat(
        F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(1).alias("c"), F.lit(0).alias("d"))),
        F.transform(F.array_distinct(t), lambda x: F.struct(x.alias("term"), F.lit(0).alias("c"), F.lit(1).alias("d")))))
    return (corpus.select(one_by_one(marks, "m")).where("m is not null").groupBy(F.col("m.term").alias("term"))
            .agg(F.sum("m.c").alias("total"), F.sum("m.d").alias("df")))


def heavy_terms(corpus: DataFrame, terms_col: str, n: int, tracked: int = TRACKED) -> tuple[list[tuple[str, int]], int]:
    """At most ``n`` candidates for the most frequent terms with estimates from above, most
    frequent first, and a bound on the count of every other term (0 if there is no other)."""
    n = min(n, tracked)
    each = corpus.select((F.spark_partition_id() % SKETCH_GROUPS).alias("g"), one_by_one(F.col(terms_col), "t")).where("t is not null")
    part = each.groupBy("g").agg(F.expr(f"approx_top_k_accumulate(t, {tracked})").alias("s"), F.count(F.lit(1)).alias("m"))
    # grouped by a constant: without rows there is no sketch to merge, and no row
    rows = part.groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"), F.sum("m").alias("m"))
    top = rows.select(F.expr(f"approx_top_k_estimate(s, {n})").alias("x"), "m").first()
    if top is None:
        return [], 0
    found = [(r["item"], r["count"]) for r in top["x"]]
    # estimates that add up to all occurrences are exact, and nothing else occurred
    whole = sum(c for _, c in found) == top["m"]
    return found, 0 if whole else found[-1][1]


def counted(corpus: DataFrame, terms_col: str, vocabulary: list[str]) -> DataFrame:
    """``term``, ``total``, ``df`` of the given terms only, by a dictionary in the row: a task sends
    one row per given term."""
    pairs = sparse(_counts(corpus, terms_col, vocabulary), "__tf")
    names = corpus.sparkSession.createDataFrame(list(enumerate(vocabulary)), "term_id int, term string")
    stats = (pairs.select(one_by_one(F.col("__tf"), "c")).where("c is not null").groupBy(F.col("c.term_id").alias("term_id"))
             .agg(F.sum("c.weight").cast("long").alias("total"), F.count(F.lit(1)).alias("df")))
    return stats.join(F.broadcast(names), "term_id").select("term", "total", "df")


def _counts(df: DataFrame, terms_col: str, vocabulary: list[str]) -> DataFrame:
    """``df`` with ``__tf``: each row's counts of the vocabulary's terms."""
    ready = df.withColumn("__terms", F.coalesce(terms_col, F.array().cast("array<string>")))
    return CountVectorizerModel.from_vocabulary(vocabulary, inputCol="__terms", outputCol="__tf").transform(ready)


def sparse(df: DataFrame, col: str) -> DataFrame:
    """``col`` as ``array<struct<term_id, weight>>`` instead of a sparse vector."""
    pair = let(F.unwrap_udt(col), lambda v: F.zip_with(v["indices"], v["values"], lambda i, w: F.struct(i.alias("term_id"), w.alias("weight"))))
    return df.withColumn(col, pair.cast(SPARSE))


def fit(corpus: DataFrame, text_col: str, max_features: int = 5000, tracked: int = TRACKED) -> TfidfModel:
    """R1 fit: vocabulary and idf from a corpus. At most ``CANDIDATES * max_features`` terms reach the driver."""
    rows = corpus.select(terms(F.col(text_col)).alias("t"))
    n_docs = corpus.select(F.count(F.lit(1))).first()[0]
    return fit_terms(rows, "t", n_docs, max_features, tracked)


def fit_terms(rows: DataFrame, terms_col: str, n_docs: int, max_features: int = 5000, tracked: int = TRACKED) -> TfidfModel:
    """``fit`` from rows that hold their terms already."""
    found, others = heavy_terms(rows, terms_col, CANDIDATES * max_features, tracked)
    best = lambda s: s.orderBy(F.desc("total"), F.asc("term")).limit(max_features).collect()
    top = best(counted(rows, terms_col, [t for t, _ in found])) if found else []
    if not certified(top, others, max_features):
        top = best(term_stats(rows, terms_col))
    return model_of(rows.sparkSession, [(r.term, r.df) for r in top], n_docs, max_features)


def certified(top: list, others: int, max_features: int) -> bool:
    """Whether no term outside the candidates can belong to the vocabulary: each occurs at most ``others`` times."""
    return others == 0 or (len(top) == max_features and top[-1]["total"] > others)


def model_of(spark, dfs: list[tuple[str, int]], n_docs: int, max_features: int) -> TfidfModel:
    """The model of a chosen vocabulary (term, document frequency); ids follow the terms' order."""
    rows = [(t, d, i) for i, (t, d) in enumerate(sorted(dfs))]
    vocab = spark.createDataFrame(rows, "term string, df long, term_id int").select(
        "term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"), "term_id")
    entries = [(r.term, r.idf) for r in sorted(vocab.collect(), key=lambda r: r.term_id)]
    vocab = spark.createDataFrame([(t, d, x, i) for (t, d, i), (_, x) in zip(rows, entries)],
                                  "term string, df long, idf double, term_id int")
    return TfidfModel(vocab=vocab, n_docs=int(n_docs), max_features=max_features, entries=entries)


def unit(model: TfidfModel, df: DataFrame, terms_col: str, out: str) -> DataFrame:
    """``df`` with ``out``: the TF-IDF vector of length one (zero without a known term) of rows that hold their terms."""
    counts = _counts(df, terms_col, [t for t, _ in model.entries])
    scale = ElementwiseProduct(scalingVec=Vectors.dense([x for _, x in model.entries]), inputCol="__tf", outputCol="__tfidf")
    rows = Normalizer(inputCol="__tfidf", outputCol=out, p=2.0).transform(scale.transform(counts))
    return rows.drop("__terms", "__tf", "__tfidf")


def vectors(model: TfidfModel, df: DataFrame, text_col: str, out: str = "vector") -> DataFrame:
    """R1 transform: ``df`` with each row's weights as ``array<struct<term_id, weight>>``, in order of
    term id. Null and empty texts have an empty vector. No row leaves its partition."""
    if not model.entries:
        return df.withColumn(out, F.array().cast(SPARSE))
    rows = unit(model, df.withColumn("__text_terms", terms(F.col(text_col))), "__text_terms", "__unit")
    return sparse(rows, "__unit").select(*df.columns, F.col("__unit").alias(out))


def packed_vectors(model: TfidfModel, df: DataFrame, text_col: str, out: str = "vector") -> DataFrame:
    """``vectors`` with ``out`` as ``struct<term_id: array<int>, weight: array<double>>``: in a row on its way, an entry
    takes 12 bytes and not the 32 of an array of structs."""
    if not model.entries:
        none = F.struct(F.array().cast("array<int>").alias("term_id"), F.array().cast("array<double>").alias("weight"))
        return df.withColumn(out, none)
    rows = unit(model, df.withColumn("__text_terms", terms(F.col(text_col))), "__text_terms", "__unit")
    pair = let(F.unwrap_udt("__unit"), lambda v: F.struct(v["indices"].alias("term_id"), v["values"].alias("weight")))
    return rows.select(*df.columns, pair.alias(out))


def transform(model: TfidfModel, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The vectors as a long table (id, term, weight); every row of ``df`` stands for itself."""
    rows = vectors(model, df.select(id_col, text_col), text_col, "__v").select(id_col, one_by_one(F.col("__v"), "e"))
    names = F.broadcast(model.vocab.select("term_id", "term"))  # at most max_features rows
    return rows.join(names, F.col("e.term_id") == F.col("term_id")).select(id_col, "term", F.col("e.weight").alias("weight"))
