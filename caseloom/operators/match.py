"""Ranking products or earlier cases against a text by shared words.

A target meets every candidate of its scope; only the wanted number of results cuts. Targets
and candidates of a scope are cut into slices of bounded size, and each pair of slices
is one task's work: it counts shared words over postings in memory and gives the best
candidates of each target. So neither pairs nor hits are shuffled or written, only the words of
both sides, each once for every slice of the other. Words are compared by 64-bit hash. Candidates
come from a pool or from an index kept beside the cases (``caseloom/operators/case_index.py``).

Products keep the job's own rule: only the newest 250 of a category are candidates.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.functions.records import product_line
from caseloom.functions.text import case_search_text, product_search_text, recommendation_text, slug, tokens
from caseloom.operators.catalog import catalog_columns
from caseloom.operators.keyed import newest_per_group
from caseloom.schemas import L, T
from caseloom.sources.tables import stage

# Product candidates per category, and results per target.
CANDIDATES, BEST = 250, 5
# Words of one side that a task walks over, about: a scope's targets and candidates are cut into slices of so many, and of
# so many rows at least.
FIRST_WALK, LEAST_ROWS = 2_000_000, 16


def candidate_pool(
    candidates: DataFrame, scope: str, key: str, recency: str, words: Column, n: int | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``(scope, key, recency, words)`` of all candidates, or of the newest ``n`` of each scope; ``keep`` adds columns.

    ``recency`` is in microseconds, so that later ones are larger.
    """
    if n is not None:
        candidates = newest_per_group(candidates, scope, recency, [key], n, "_place")
    return candidates.select(
        F.col(scope).alias("scope"), F.col(key).alias("key"),
        F.coalesce(F.unix_micros(F.col(recency).cast("timestamp")), F.lit(-(2**63))).alias("recency"),
        words.alias("words"), *(keep or []),
    )


def pool_postings(pool: DataFrame) -> DataFrame:
    """``(scope, word, key, recency)`` of a ``candidate_pool``, whose keys are unique."""
    # A plain explode would filter on the size of the words first, which means finding them twice.
    return pool.select("scope", F.explode_outer("words").alias("word"), "key", "recency")


def best_by_bounds(targets: DataFrame, postings: DataFrame, k: int = BEST, first_walk: int = FIRST_WALK) -> DataFrame:
    """``(target_id, position, key, score)``: the ``k`` candidates sharing most words with each target.

    Exact. ``postings`` are ``(scope, word, key, recency)``; a slice holds some ``first_walk`` of them. A
    repeated target or posting counts as often as it is there.
    """
    words = F.collect_list(F.xxhash64("word")).alias("words")
    candidates = postings.filter("word is not null").groupBy("scope", "key", "recency").agg(words)
    return best_of(targets, candidates, k, first_walk)


def _hashed(words: str) -> Column:
    return F.transform(F.filter(words, lambda w: w.isNotNull()), lambda w: F.xxhash64(w)).alias("words")


def best_of(targets: DataFrame, candidates: DataFrame, k: int, walk: int) -> DataFrame:
    """The best of ``candidates`` ``(scope, key, recency, words)``, whose words are hashed."""
    asked = targets.select("target_id", "scope", _hashed("words")).groupBy("target_id", "scope")
    asked = asked.agg(F.flatten(F.collect_list("words")).alias("words"))
    asked = stage(asked.filter("scope is not null and size(words) > 0"), "asked-words")
    pool = stage(candidates.filter("scope is not null and size(words) > 0"), "candidate-words")

    def cuts(rows: DataFrame, name: str) -> DataFrame:
        cut = F.least(F.ceil(F.sum(F.size("words")) / walk), F.ceil(F.count(F.lit(1)) / LEAST_ROWS))
        return rows.groupBy("scope").agg(cut.cast("int").alias(name))

    # Written, so that its size is known: one row a scope, which is broadcast.
    slices = stage(cuts(asked, "asked_in").join(cuts(pool, "pool_in"), "scope"), "slices")
    own = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(slices, "scope").select(
        "scope", own("target_id", "asked_in").alias("i"), every("pool_in").alias("j"), "target_id", "words"
    )
    right = pool.join(slices, "scope").select(
        "scope", every("asked_in").alias("i"), own("key", "pool_in").alias("j"), "key", "recency", "words"
    )
    fields = [asked.schema["target_id"], pool.schema["key"], T.StructField("recency", L), T.StructField("score", L)]

    def count(asking: pa.Table, held: pa.Table) -> pa.Table:
        return _count(asking, held, k)

    tiles = left.groupBy("scope", "i", "j").cogroup(right.groupBy("scope", "i", "j"))
    scored = tiles.applyInArrow(count, T.StructType(fields))
    place = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("score"), F.desc("recency"), "key"))
    return scored.withColumn("position", place.cast("bigint")).filter(F.col("position") <= k).select(
        "target_id", "position", "key", "score"
    )


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, one after the other, and how many each row has."""
    column = table.column(name)
    return pc.list_flatten(column).to_numpy(), pc.list_value_length(column).to_numpy()


def _count(asked: pa.Table, pool: pa.Table, k: int) -> pa.Table:
    """``target_id``, ``key``, ``recency`` and ``score`` of each target's best ``k`` in one slice of candidates."""
    # Candidates are numbered from the newest on, equal ones to the smaller key; rows of one candidate share a number.
    order = pc.sort_indices(pool.select(["key", "recency"]), [("recency", "descending"), ("key", "ascending")], null_placement="at_start")
    pool = pool.take(order)
    recency = pool.column("recency").to_numpy()
    keys = pool.column("key").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (recency[1:] != recency[:-1]) | (keys[1:] != keys[:-1])
    n, first = int(fresh.sum()), np.flatnonzero(fresh)

    words, sizes = _lists(pool, "words")
    holder = np.repeat(np.cumsum(fresh) - 1, sizes)
    wanted, asked_sizes = _lists(asked, "words")
    vocabulary, wanted = np.unique(wanted, return_inverse=True)
    at = np.searchsorted(vocabulary, words)
    at[at == len(vocabulary)] = 0
    met = vocabulary[at] == words if len(vocabulary) else np.zeros(len(words), bool)
    word, holder = at[met], holder[met]
    by_word = np.argsort(word, kind="stable")
    holder, bounds = holder[by_word], np.searchsorted(word[by_word], np.arange(len(vocabulary) + 1)).tolist()

    age, rows, places, scores = np.arange(n), [], [], []
    ends = np.cumsum(asked_sizes)
    for row, mine in enumerate(np.split(wanted, ends[:-1])):
        shared = np.bincount(np.concatenate([holder[:0], *[holder[bounds[w] : bounds[w + 1]] for w in mine.tolist()]]), minlength=n)
        ranked = shared * n - age
        best = np.argpartition(ranked, n - k)[n - k :] if k < n else age
        best = best[shared[best] > 0]
        rows.append(np.full(len(best), row))
        places.append(best)
        scores.append(shared[best])
    rows, places, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, places, scores))
    found = first[places]
    return pa.table({
        "target_id": asked.column("target_id").take(pa.array(rows)), "key": pool.column("key").take(pa.array(found)),
        "recency": pa.array(recency[found], pa.int64()), "score": pa.array(scores, pa.int64()),
    })


def token_overlap(targets: DataFrame, pool: DataFrame, k: int = BEST) -> DataFrame:
    """``(target_id, position, key, score)``: the ``k`` candidates sharing most words with each target.

    ``targets`` are ``(target_id, scope, words)``, ``pool`` is a ``candidate_pool``. Equal
    scores go to the newer candidate, then to the smaller key.
    """
    return best_of(targets, pool.select("scope", "key", "recency", _hashed("words")), k, FIRST_WALK)


def top_k(scored: DataFrame, k: int = BEST) -> DataFrame:
    """The best ``k`` of rows that carry their position."""
    return scored.filter(F.col("position") <= k)


def recommend_products(
    requests: DataFrame, catalog: DataFrame, id_column: str, k: int = BEST, cap: int = CANDIDATES
) -> DataFrame:
    """The best active products of each request's category, with the candidate columns and the score."""
    shown = catalog_columns(catalog).columns
    shortlist = catalog_columns(catalog.filter("is_active"), "app_category_slug")
    # A stored product without search text is found by what its shown columns say.
    shown_text = product_search_text(
        F.lit(""), *[F.col(c) for c in ("source_label", "product_name", "sku", "brand", "short_description", "specs")]
    )
    searched = F.coalesce(F.nullif(F.col("searchable_text"), F.lit("")), shown_text)
    pool = candidate_pool(
        shortlist, "app_category_slug", "product_url", "last_synced_at", tokens(searched), cap,
        [name for name in shown if name != "product_url"],
    )
    targets = requests.filter(F.coalesce(F.col("category"), F.lit("")) != "").select(
        F.col(id_column).alias("target_id"), slug(F.col("category")).alias("scope"),
        tokens(recommendation_text()).alias("words"),
    )
    best = token_overlap(targets, pool, k)
    products = pool.withColumnRenamed("key", "product_url").select(*shown)
    return best.withColumnRenamed("key", "product_url").join(products, "product_url").withColumnRenamed(
        "target_id", id_column
    )


def similar_cases(targets: DataFrame, cases: DataFrame, k: int = BEST) -> DataFrame:
    """The best learning-eligible cases for targets ``(target_id, scope, words)``.

    ``cases`` carry ``(scope, case_number, updated_at, search_text, learning_eligible)``; every
    eligible case of the target's scope, its category, is looked at.
    """
    pool = candidate_pool(
        cases.filter("learning_eligible"), "scope", "case_number", "updated_at", tokens(F.col("search_text"))
    )
    return token_overlap(targets, pool, k).withColumnRenamed("key", "case_number")


def request_words(requests: DataFrame, id_column: str, scope: Column) -> DataFrame:
    """Case requests as matching targets."""
    return requests.select(
        F.col(id_column).alias("target_id"), scope.alias("scope"), tokens(case_search_text()).alias("words")
    )


# The lines around a rendered product list.
NO_PRODUCTS = "No synced shop products were found for this case category."
PRODUCTS_HEAD = [
    "Use these synced shop products as the preferred recommendation pool.",
    "If they fit the case, prioritize them over generic suggestions and reference their exact product names or SKU "
    "codes.",
]


def render_products(ranked: DataFrame, id_column: str, ids: DataFrame | None = None) -> DataFrame:
    """One numbered text block per case from its ranked products (a handful: the rows are cut before).

    With ``ids``, cases without any product get the text that says so.
    """
    lines = F.transform(F.sort_array(F.collect_list(F.struct("position", "_line"))), lambda x: x["_line"])
    blocks = (
        ranked.withColumn("_line", product_line(F.col("position")))
        .groupBy(id_column)
        .agg(F.concat_ws("\n", *[F.lit(line) for line in PRODUCTS_HEAD], lines).alias("block"))
    )
    if ids is None:
        return blocks
    return ids.select(id_column).join(blocks, id_column, "left").fillna(NO_PRODUCTS, ["block"])
