"""Precomputed recommendations: popularity, pools, item similarity, routing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazarlens.operators.sales import filter_delivered
from bazarlens.session import materialize

# Interaction weights relative to a purchase; not known from results, ours.
DEFAULT_WEIGHTS = {"purchase": 1.0, "cart": 0.5, "click": 0.3, "view": 0.1}
# A basket part holds about this many products; so does one whose pairs are formed.
BASKET_PART = 512
PAIR_PART = 64
# Buyers of a product that one task counts, and products of their baskets that it holds between two merges.
HOT_BUYERS = 50_000
HELD_MEMBERS = 200_000
# A price band holds about this many products of a category.
BAND_SIZE = 100_000


# --- purchases and popularity -------------------------------------------------


def purchases(orders: DataFrame, items: DataFrame, customers: DataFrame) -> DataFrame:
    """(customer, product, units, spend), one row per pair."""
    sold = filter_delivered(orders).select("order_id", "customer_id").join(items.select("order_id", "product_id", "price"), "order_id")
    per_account = sold.groupBy("customer_id", "product_id").agg(F.count(F.lit(1)).alias("units"), F.sum("price").alias("spend"))
    return (
        per_account.join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy(F.col("customer_unique_id").alias("customer"), F.col("product_id").alias("product"))
        .agg(F.sum("units").alias("units"), F.sum("spend").alias("spend"))
    )


def product_popularity(bought: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Buyers, units and revenue per product (and per ``extra`` columns)."""
    return bought.groupBy(*(extra or []), "product").agg(
        F.count(F.lit(1)).alias("buyers"), F.sum("units").alias("units"), F.sum("spend").alias("revenue")
    )


def top_products(popularity: DataFrame, k: int, partition: list[str] | None = None) -> DataFrame:
    """The k products with most units, overall or within each partition.

    The rank filter reaches the map side, so a task sends k rows a group.
    """
    order = [F.desc("units"), F.desc("revenue"), F.asc("product")]
    if not partition:
        best = popularity.orderBy(*order).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return popularity.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def candidate_pool(bought: DataFrame, segments: DataFrame, ratings: DataFrame | None = None, size: int = 100) -> DataFrame:
    """The best products of each segment by purchases, revenue and rating.

    ``score`` is the mean of the shares of the segment's largest value; a
    product without a rating gets none for it. ``segments`` is
    (customer, segmento), ``ratings`` is (product, rating).
    """
    popularity = product_popularity(bought.join(segments, "customer"), ["segmento"])
    if ratings is None:
        rated = popularity.withColumn("rating", F.lit(None).cast("double"))
    else:
        rated = popularity.join(ratings, "product", "left")
    largest = rated.groupBy("segmento").agg(
        F.max("units").alias("max_units"), F.max("revenue").alias("max_revenue"), F.max("rating").alias("max_rating")
    )
    shares = [
        F.try_divide(F.col("units"), F.col("max_units")),
        F.try_divide(F.col("revenue"), F.col("max_revenue")),
        F.coalesce(F.try_divide(F.col("rating"), F.col("max_rating")), F.lit(0.0)),
    ]
    scored = rated.join(largest, "segmento").withColumn("score", F.bround((shares[0] + shares[1] + shares[2]) / 3, 6))
    rank = F.row_number().over(Window.partitionBy("segmento").orderBy(F.desc("score"), F.asc("product")))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= size).select("segmento", "rank", "product", "score")


def product_ratings(reviews: DataFrame, items: DataFrame) -> DataFrame:
    """Mean review score per product over review x item rows.

    Both sides are combined per order first, so no pair is expanded.
    """
    scores = reviews.groupBy("order_id").agg(F.sum("review_score").alias("score_sum"), F.count("review_score").alias("n_scores"))
    counts = items.groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("n_items"))
    return (
        counts.join(scores, "order_id")
        .groupBy(F.col("product_id").alias("product"))
        .agg(
            F.try_divide(F.sum(F.col("score_sum") * F.col("n_items")), F.sum(F.col("n_scores") * F.col("n_items"))).alias("rating")
        )
    )


def exclude_purchased(candidates: DataFrame, bought: DataFrame) -> DataFrame:
    """Candidates (customer, product, ...) that were not bought before."""
    return candidates.join(bought.select("customer", "product"), ["customer", "product"], "left_anti")


def segment_candidates(segments: DataFrame, pool: DataFrame, bought: DataFrame) -> DataFrame:
    """(customer, segmento, product, rank): the pool of the segment without what was bought.

    Purchases outside the pools are dropped first; the rest is one array per
    customer, taken from the pool's array, so no row per customer and pool
    product is formed before the end.
    """
    pooled = pool.select("product").distinct()
    owned = bought.join(pooled, "product", "left_semi").groupBy("customer").agg(F.collect_set("product").alias("owned"))
    lists = pool.groupBy("segmento").agg(F.collect_list(F.struct("product", "rank")).alias("pool"))
    left = F.filter("pool", lambda x: ~F.coalesce(F.array_contains("owned", x["product"]), F.lit(False)))
    return segments.join(lists, "segmento").join(owned, "customer", "left").select("customer", "segmento", F.inline(left))


# --- item based collaborative filtering ----------------------------------------


def basket_parts(bought: DataFrame, part_size: int = PAIR_PART) -> DataFrame:
    """Products of each customer in blocks of pairs of basket parts.

    A basket of d products is cut into C = ceil(d / part_size) parts by hash.
    Each pair of parts is a group of its own, so a customer who bought very
    much is spread over C*(C+1)/2 groups, all of bounded size; an ordinary
    basket is one group. Nothing is dropped; a null customer equals no other.
    """
    sized = bought.groupBy("customer").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_size)).cast("int").alias("parts"))
    # Adaptive execution splits a large basket's side of this join.
    placed = bought.join(sized, "customer").select(
        "customer", "product", "parts", F.pmod(F.xxhash64("product", F.lit("part")), F.col("parts")).cast("int").alias("part")
    )
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return paired.groupBy(
        "customer", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b")
    ).agg(F.collect_list(F.struct("product", "part")).alias("members"))


def item_cooccurrence(bought: DataFrame, part_size: int = PAIR_PART) -> DataFrame:
    """(product_a < product_b, n_customers): customers who bought both, for every pair that anybody bought.

    Pairs are formed inside the bounded groups of :func:`basket_parts` and
    counted in the same stage, so the shuffle carries counts.
    """
    groups = basket_parts(bought, part_size)
    same_part = F.col("part_a") == F.col("part_b")
    pairs = (
        groups.select("members", same_part.alias("same_part"), F.explode("members").alias("a"))
        .select("same_part", "a", F.explode("members").alias("b"))
        .filter((F.col("a.product") < F.col("b.product")) & (F.col("same_part") | (F.col("a.part") != F.col("b.part"))))
    )
    return pairs.groupBy(F.col("a.product").alias("product_a"), F.col("b.product").alias("product_b")).agg(
        F.count(F.lit(1)).alias("n_customers")
    )


def item_similarity(cooccurrence: DataFrame, bought: DataFrame) -> DataFrame:
    """Cosine of the buyer sets: c_ab / sqrt(c_a * c_b)."""
    buyers = bought.groupBy("product").agg(F.count(F.lit(1)).alias("buyers"))
    a = buyers.select(F.col("product").alias("product_a"), F.col("buyers").alias("buyers_a"))
    b = buyers.select(F.col("product").alias("product_b"), F.col("buyers").alias("buyers_b"))
    cosine = F.col("n_customers") / F.sqrt(F.col("buyers_a").cast("double") * F.col("buyers_b"))
    return cooccurrence.join(a, "product_a").join(b, "product_b").withColumn("similarity", cosine)


class _Neighbours:
    """Counts how many baskets of one product hold each other product, as far as it may be among the k best.

    Baskets come with the small ones first. A product that was not met before
    can be in no more baskets than remain; if even that many would not lift it
    over the k-th best value so far, it is not counted at all. What has been
    counted is dropped once the remaining baskets cannot lift it.
    """

    def __init__(self, buyers: int, k: int, cosine: bool, held: int):
        self.buyers, self.k, self.cosine, self.held = buyers, k, cosine, held
        self.other, self.n, self.their = (np.zeros(0, np.int64) for _ in range(3))
        self.buffer: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting, self.done, self.left, self.floor = 0, 0, buyers, 0.0

    def value(self, n: np.ndarray | int, their: np.ndarray) -> np.ndarray:
        return n / np.sqrt(float(self.buyers) * their) if self.cosine else n * np.ones(len(their))

    def add(self, other: np.ndarray, their: np.ndarray, last: bool) -> None:
        """A basket or a part of one; ``last`` ends the basket."""
        if self.floor:
            # The bound of the last merge: what it lets in is let in until the next one, and so counted in full.
            useful = self.value(self.left, their) >= self.floor * (1 - 1e-9)
            if len(self.other):
                place = np.minimum(np.searchsorted(self.other, other), len(self.other) - 1)
                useful |= self.other[place] == other
            other, their = other[useful], their[useful]
        self.buffer.append((other, their))
        self.waiting += len(other)
        self.done += last
        if self.waiting > self.held:
            self.merge()

    def merge(self) -> None:
        other = np.concatenate([self.other, *(x for x, _ in self.buffer)])
        their = np.concatenate([self.their, *(x for _, x in self.buffer)])
        n = np.concatenate([self.n, np.ones(len(other) - len(self.n), np.int64)])
        self.buffer, self.waiting = [], 0
        self.other, first, inverse = np.unique(other, return_index=True, return_inverse=True)
        self.n, self.their = np.bincount(inverse, n, len(first)).astype(np.int64), their[first]
        if len(self.n) > self.k:
            now = self.value(self.n, self.their)
            self.floor = float(np.partition(now, len(now) - self.k)[len(now) - self.k])
            self.left = self.buyers - self.done
            stays = self.value(self.n + self.left, self.their) >= self.floor * (1 - 1e-9)
            self.other, self.n, self.their = self.other[stays], self.n[stays], self.their[stays]

    def best(self) -> np.ndarray:
        """Places of the k best; equal values go by the product's number."""
        return np.lexsort((self.other, -self.value(self.n, self.their)))[: self.k]


def top_neighbours(
    bought: DataFrame, k: int = 10, cosine: bool = True, part_size: int = BASKET_PART, hot_buyers: int = HOT_BUYERS, held: int = HELD_MEMBERS
) -> DataFrame:
    """(product_a, product_b, n_customers, similarity, rank): the k products most like each product.

    Likeness is the cosine of the buyer sets, c_ab / sqrt(c_a * c_b), or with
    ``cosine=False`` the number of common buyers; equal values go by ascending
    product. Baskets travel to their products as arrays and are counted
    there, one product at a time, so a pair is never a row; see
    :class:`_Neighbours` for the pairs that are not even counted. Parts of a
    basket hold about ``part_size`` products. A product with more than
    ``hot_buyers`` buyers is dealt out by customer; then its partial counts
    are added up. A null customer equals no other.
    """
    buyers = bought.filter(F.col("customer").isNotNull()).groupBy("product").agg(F.count(F.lit(1)).alias("buyers"))
    # Numbers in the order of the products; they are written, so they stay what they are.
    numbered = materialize(buyers.orderBy("product").withColumn("number", F.monotonically_increasing_id()), "products")
    known = bought.select("customer", "product").join(numbered, "product").select("customer", "number", "buyers")
    spread = known.groupBy("customer").agg(F.count(F.lit(1)).alias("size"))
    placed = known.join(spread, "customer").withColumn("parts", F.ceil(F.col("size") / F.lit(part_size)).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("number"), F.col("parts")).cast("int"))
    members = F.array_sort(F.collect_list(F.struct("number", "buyers")))
    parts = placed.groupBy("customer", "part").agg(members.alias("members"))
    salts = F.ceil(F.col("buyers") / F.lit(hot_buyers)).cast("int")
    # Every part of a basket exists as far as a hash fell into it; the last of those ends the basket.
    last = parts.groupBy("customer").agg(F.max("part").alias("last"))
    met = placed.select("customer", "number", "buyers", "size").join(parts.join(last, "customer"), "customer")
    met = met.select(
        "number", "buyers", salts.alias("salts"), F.pmod(F.xxhash64("customer"), salts).cast("int").alias("salt"), "size", "customer", "part",
        (F.col("part") == F.col("last")).alias("ends"), F.col("members.number").alias("others"), F.col("members.buyers").alias("theirs"),
    )
    ordered = met.repartition("number", "salt").sortWithinPartitions("number", "salt", "size", "customer", "part")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, salted = None, None, 1
        found: list[tuple] = []

        def finish() -> None:
            own.merge()
            chosen = own.best() if salted == 1 else np.arange(len(own.n))
            found.append((np.full(len(chosen), group[0]), own.other[chosen], own.n[chosen]))

        for batch in batches:
            number, buyers_, salts_, salt, ends = (batch.column(i).to_pylist() for i in range(5))
            edges = batch.column(5).offsets.to_numpy()
            others, theirs = (batch.column(i).values.to_numpy() for i in (5, 6))
            for i in range(len(number)):
                if group != (number[i], salt[i]):
                    if group is not None:
                        finish()
                    group, salted = (number[i], salt[i]), salts_[i]
                    own = _Neighbours(buyers_[i], k, cosine, held)
                span = slice(edges[i], edges[i + 1])
                self_ = others[span] != number[i]
                own.add(others[span][self_], theirs[span][self_], ends[i])
            if found:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b", "n"])
                found.clear()
        if group is not None:
            finish()
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b", "n"])

    counted = ordered.select("number", "buyers", "salts", "salt", "ends", "others", "theirs").mapInArrow(count, "a long, b long, n long")
    counted = counted.groupBy("a", "b").agg(F.sum("n").alias("n_customers"))
    side = lambda name: numbered.select(F.col("number").alias(name), F.col("product").alias(f"product_{name}"), F.col("buyers").alias(f"buyers_{name}"))
    similarity = F.col("n_customers") / F.sqrt(F.col("buyers_a").cast("double") * F.col("buyers_b"))
    named = counted.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", similarity)
    value = F.col("similarity" if cosine else "n_customers")
    rank = F.row_number().over(Window.partitionBy("product_a").orderBy(value.desc(), F.asc("product_b")))
    ranked = named.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)
    return ranked.select("product_a", "product_b", "n_customers", "similarity", "rank")


def pool_similarity(bought: DataFrame, pool: DataFrame) -> DataFrame:
    """(product, candidate, similarity) with a pool product at one end.

    The cosine of :func:`top_neighbours` where the second product is in a pool,
    but only purchases x pool rows are counted, not all pairs of a basket.
    """
    candidates = bought.select("customer", F.col("product").alias("candidate")).join(
        pool.select(F.col("product").alias("candidate")).distinct(), "candidate", "left_semi"
    )
    both = bought.select("customer", "product").join(candidates, "customer").filter(F.col("product") != F.col("candidate"))
    counts = both.groupBy("product", "candidate").agg(F.count(F.lit(1)).alias("n_customers"))
    buyers = bought.groupBy("product").agg(F.count(F.lit(1)).alias("buyers"))
    of_candidate = buyers.select(F.col("product").alias("candidate"), F.col("buyers").alias("candidate_buyers"))
    cosine = F.col("n_customers") / F.sqrt(F.col("buyers").cast("double") * F.col("candidate_buyers"))
    return counts.join(of_candidate, "candidate").join(buyers, "product").select("product", "candidate", cosine.alias("similarity"))


def _ranked(signals: DataFrame, owned: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each customer that are not owned, from rows of (customer, product, signal).

    What was bought goes into the same aggregate as a row without a signal,
    so that leaving it out needs no second join on (customer, product).
    """
    own = owned.select("customer", "product", F.lit(None).cast("double").alias("signal"))
    scored = (
        signals.select("customer", "product", "signal")
        .unionByName(own)
        .groupBy("customer", "product")
        .agg(F.sum("signal").alias("total"), F.count("signal").alias("n"), F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n") == F.col("n_rows"))
        .select("customer", "product", F.bround("total", 6).alias("score"))
    )
    rank = F.row_number().over(Window.partitionBy("customer").orderBy(F.desc("score"), F.asc("product")))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def _implicit_signals(implicit: DataFrame | None, segments: DataFrame, pool: DataFrame, share: float, like: DataFrame) -> DataFrame:
    """Weighted interactions with pool products of the own segment, as further signals."""
    if implicit is None or not share:
        return like.limit(0)
    placed = implicit.select(F.col("customer_id").alias("customer"), F.col("product_id").alias("product"), "score").join(segments, "customer")
    kept = placed.join(pool.select("segmento", "product"), ["segmento", "product"], "left_semi")
    return kept.select("customer", "product", (F.col("score") * F.lit(share)).alias("signal"))


def item_cf_rank(
    bought: DataFrame, segments: DataFrame, pool: DataFrame, k: int = 10, implicit: DataFrame | None = None, implicit_share: float = 0.0
) -> DataFrame:
    """The k best products of the segment's pool that a customer did not buy.

    ``segments`` is (customer, segmento), ``pool`` is (segmento, product). The
    score is the sum of the similarities to what was bought, plus
    ``implicit_share`` times the weighted interactions (customer_id,
    product_id, score) of ``implicit``. Each purchase meets the pool products
    of its customer's segment and no others.
    """
    near = pool_similarity(bought, pool).join(pool.select("segmento", F.col("product").alias("candidate")), "candidate")
    seeds = bought.select("customer", "product").join(segments.select("customer", "segmento"), "customer")
    signals = seeds.join(near, ["segmento", "product"]).select("customer", F.col("candidate").alias("product"), F.col("similarity").alias("signal"))
    wanted = segments.select("customer", "segmento")
    return _ranked(signals.unionByName(_implicit_signals(implicit, wanted, pool, implicit_share, signals)), bought, k)


# --- content based ---------------------------------------------------------------


def price_bands(product_features: DataFrame, k: int, band_size: int = BAND_SIZE) -> DataFrame:
    """Adds ``band`` and ``own``: price bands of about ``band_size`` products of a category.

    A category is cut where its products, numbered in (price, product) order,
    pass a multiple of ``band_size``: ranges of its price histogram decide the
    band, so only prices with their counts are summed up, and one price that
    fills several bands is dealt on by product. Each band also gets, as rows
    that are not its own, the k outer rows of the bands on either side.
    """
    prices = product_features.groupBy("categoria", "price").agg(F.count(F.lit(1)).alias("n"), F.min("product").alias("low"), F.max("product").alias("high"))
    before = F.sum("n").over(Window.partitionBy("categoria").orderBy("price").rowsBetween(Window.unboundedPreceding, -1))
    first = F.floor(F.coalesce(before, F.lit(0)) / F.lit(band_size))
    # Inside one price, ids are cut into ranges of equal width; their order is kept.
    parts = F.greatest(F.ceil(F.col("n") / F.lit(band_size)), F.lit(1))
    width = F.ceil((F.col("high") - F.col("low") + 1) / parts)
    cut = prices.select("categoria", "price", first.alias("first"), "low", width.alias("width"), parts.alias("parts"))
    inside = F.floor((F.col("product") - F.col("low")) / F.col("width"))
    own = product_features.join(cut, ["categoria", "price"]).select(
        "product", "categoria", "price", F.struct("first", F.when(F.col("parts") > 1, F.col("price")).alias("price"), F.when(F.col("parts") > 1, inside).alias("part")).alias("at")
    )
    # Bands that hold rows, numbered without gaps: one row per band.
    numbers = own.groupBy("categoria", "at").agg(F.min(F.struct("price", "product")).alias("begin"))
    number = F.row_number().over(Window.partitionBy("categoria").orderBy("begin"))
    own = own.join(numbers.select("categoria", "at", number.alias("band")), ["categoria", "at"]).drop("at")
    group = Window.partitionBy("categoria", "band")
    low = F.row_number().over(group.orderBy("price", "product"))
    high = F.row_number().over(group.orderBy(F.desc("price"), F.desc("product")))
    lows = own.withColumn("place", low).filter(F.col("place") <= k)
    highs = own.withColumn("place", high).filter(F.col("place") <= k)
    columns = ["product", "categoria", "price"]
    # A band may hold fewer than k rows, so the outer rows go k bands far.
    halo = lows.select(*columns, F.explode(F.sequence(F.col("band") - k, F.col("band") - 1)).alias("band")).unionByName(
        highs.select(*columns, F.explode(F.sequence(F.col("band") + 1, F.col("band") + k)).alias("band"))
    )
    return own.select(*columns, "band", F.lit(True).alias("own")).unionByName(halo.withColumn("own", F.lit(False)))


def content_similarity(product_features: DataFrame, k: int = 5, band_size: int = BAND_SIZE) -> DataFrame:
    """The k products of the same category with the nearest price.

    ``product_features`` is (product, categoria, price). Equal gaps go to the
    nearer place in (price, product) order, then to the lower id. So the k
    nearest lie among the k places before and after, and each product looks at
    2k others instead of at its whole category. Categories are sorted in
    bands, see :func:`price_bands`. ``product`` is a whole number.
    """
    order = Window.partitionBy("categoria", "band").orderBy("price", "product")
    other = F.struct("product", "price")
    places = [p for i in range(1, k + 1) for p in ((F.lag(other, i), i), (F.lead(other, i), i))]
    around = F.array(*[F.struct(value.over(order).alias("other"), F.lit(i).alias("places")) for value, i in places])
    gap = F.abs(F.col("other.price") - F.col("price"))
    neighbours = (
        price_bands(product_features.select("product", "categoria", "price"), k, band_size)
        .withColumn("around", around)
        .filter("own")
        .select("product", "categoria", "price", F.inline("around"))
        .filter(F.col("other").isNotNull())
        .select("product", "categoria", F.col("other.product").alias("neighbour"), gap.alias("price_gap"), "places")
    )
    rank = F.row_number().over(Window.partitionBy("product").orderBy("price_gap", "places", "neighbour"))
    return (
        neighbours.withColumn("rank", rank.cast("long"))
        .filter(F.col("rank") <= k)
        .withColumn("similarity", F.lit(1.0) / (F.lit(1.0) + F.col("price_gap")))
        .drop("places")
    )


# --- routing -----------------------------------------------------------------------


def recommend_route(customers: DataFrame, bought: DataFrame, rich_from: int = 3) -> DataFrame:
    """Which algorithm serves each customer, by distinct products bought.

    ``rich_from`` ("several products") is not known from results; ours.
    """
    history = bought.groupBy("customer").agg(F.count(F.lit(1)).alias("n_products"))
    n = F.coalesce(F.col("n_products"), F.lit(0))
    route = F.when(n >= rich_from, "item_cf").when(n >= 1, "content").otherwise("popular")
    return customers.join(history, "customer", "left").select("customer", n.alias("n_products"), route.alias("route"))


def content_rank(bought: DataFrame, segments: DataFrame, pool: DataFrame, features: DataFrame, k: int = 10) -> DataFrame:
    """The k pool products that are most like something bought.

    ``features`` is (product, categoria, price) and may have ``traits``, an
    array of further features. Likeness is 1 / (1 + price gap) within the
    category, plus the share of the bought product's traits that are met. A
    category without a pool product gives no candidate.
    """
    traits = F.col("traits") if "traits" in features.columns else F.array().cast("array<string>")
    features = features.select("product", "categoria", "price", traits.alias("traits"))
    wanted = pool.select("segmento", "product").join(features, "product").select(
        "segmento", "categoria", F.col("product").alias("candidate"), F.col("price").alias("candidate_price"), F.col("traits").alias("candidate_traits")
    )
    seeds = bought.select("customer", "product").join(segments.select("customer", "segmento"), "customer").join(features, "product")
    met = F.try_divide(F.size(F.array_intersect("traits", "candidate_traits")).cast("double"), F.size("traits").cast("double"))
    likeness = F.lit(1.0) / (F.lit(1.0) + F.abs(F.col("price") - F.col("candidate_price"))) + F.coalesce(met, F.lit(0.0))
    signals = seeds.join(wanted, ["segmento", "categoria"]).groupBy("customer", F.col("candidate").alias("product")).agg(F.max(likeness).alias("signal"))
    return _ranked(signals, bought, k)


def recommend(
    routes: DataFrame,
    bought: DataFrame,
    segments: DataFrame,
    pool: DataFrame,
    features: DataFrame,
    popularity: DataFrame,
    k: int = 10,
    implicit: DataFrame | None = None,
    implicit_share: float = 0.0,
) -> DataFrame:
    """Top k per customer: candidates from the segment's pool, ranked by the branch that serves the customer.

    Customers without a purchase have no pool; they get the popular products,
    k rows that enter as one array value, not by a join. Cold starts in a
    known category are :func:`top_products` with that category as partition.
    """
    served = {r: routes.filter(F.col("route") == r).select("customer") for r in ("item_cf", "content", "popular")}
    # Similar products come from all buyers, but only served customers are ranked.
    rich, poor = (segments.join(served[r], "customer", "left_semi") for r in ("item_cf", "content"))
    cf = item_cf_rank(bought, rich, pool, k, implicit, implicit_share).join(served["item_cf"], "customer", "left_semi")
    near = content_rank(bought.join(served["content"], "customer", "left_semi"), poor, pool, features, k)
    popular = (
        top_products(popularity, k)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "product", F.col("units").cast("double").alias("score")))))
        .scalar()
    )
    cold = served["popular"].select("customer", F.inline(popular))
    columns = ["customer", "product", "score", "rank"]
    parts = [
        frame.select(*columns, F.lit(route).alias("route"))
        for route, frame in [("item_cf", cf), ("content", near), ("popular", cold)]
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def implicit_weights(events: DataFrame, weights: dict[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Weighted interactions per customer and product.

    ``events`` is (customer_id, product_id, event_type). The weights are a
    literal map; counts are combined per type before they are weighted.
    """
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return (
        events.filter(F.col("event_type").isin(*weights))
        .groupBy("customer_id", "product_id")
        .agg(F.sum(F.element_at(table, F.col("event_type"))).alias("score"), F.count(F.lit(1)).alias("n_events"))
    )
