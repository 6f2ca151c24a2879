"""Seeded graph generators: (src, dst, weight) tables that are the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rand
from ..operators.edges import cleaned


def _weighted(pairs: DataFrame, weight: int | tuple[int, int], seed: int) -> DataFrame:
    """The pairs with a constant weight or one uniform in [low, high]."""
    w = F.lit(weight).cast("long") if isinstance(weight, int) else rand.uniform_int(*weight, seed, F.lit("weight"), "src", "dst")
    return pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("weight"))


def _pairs(spark: SparkSession, n: int) -> DataFrame:
    """All i < j below n, each i unfolding its own partners."""
    return spark.range(max(n - 1, 0)).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("dst"))


def complete(spark: SparkSession, n: int, weight: int | tuple[int, int] = (1, 100), seed: int = 0) -> DataFrame:
    return _weighted(_pairs(spark, n), weight, seed)


def ring_lattice(spark: SparkSession, n: int, d: int, weight: int | tuple[int, int] = (10, 200), seed: int = 0) -> DataFrame:
    """Edges i to (i + j) mod n for j from 1 to d."""
    pairs = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(d))).alias("j"))
    return _weighted(pairs.select("src", ((F.col("src") + F.col("j")) % n).alias("dst")), weight, seed)


def clustered_similarity(spark: SparkSession, n: int, clusters: int = 10, seed: int = 0) -> DataFrame:
    """Complete graph of similarities: normal of mean 8 within a cluster (equal id mod clusters) and 4 across, deviation 4, cut off at 0 and to whole numbers."""
    mean = F.when(F.pmod("src", F.lit(clusters)) == F.pmod("dst", F.lit(clusters)), 8.0).otherwise(4.0)
    value = rand.normal(mean, 4.0, seed, "src", "dst")
    return _pairs(spark, n).select("src", "dst", F.floor(F.greatest(F.lit(0.0), value)).cast("long").alias("weight"))


def erdos_renyi(spark: SparkSession, n: int, p: float, weight: int | tuple[int, int] = 100, seed: int = 0) -> DataFrame:
    """Each pair with probability p. Partners of a vertex come from geometric skips over blocks of pairs, so that sparse graphs cost about their edges."""
    if p <= 0 or n < 2:
        return _weighted(_pairs(spark, 0), weight, seed)
    if p >= 0.2:
        return _weighted(_pairs(spark, n).filter(rand.uniform(seed, "src", "dst") < p), weight, seed)
    # a vertex's number of partners above it is binomial; it is drawn by skips: floor(log(u) / log(1 - p)) non-edges before each edge
    most = F.ceil((F.lit(n - 1) - F.col("src")) * p + 12 * F.sqrt((F.lit(n) - F.col("src")) * p) + 12)
    skips = spark.range(n - 1).select(F.col("id").alias("src")).withColumn("k", F.explode(F.sequence(F.lit(1), most.cast("int"))))
    step = F.floor(F.log(1.0 - rand.uniform(seed, "src", "k")) / F.log1p(F.lit(-p))) + 1
    at = F.sum(step).over(Window.partitionBy("src").orderBy("k"))
    return _weighted(skips.withColumn("dst", F.col("src") + at).filter(F.col("dst") < n), weight, seed)


def small_world(spark: SparkSession, n: int, k: int, p: float = 0.3, weight: int | tuple[int, int] = 100, seed: int = 0) -> DataFrame:
    """Ring lattice of degree k whose edges change their far end, with probability p, to a vertex chosen by hash; loops and repetitions are dropped."""
    base = ring_lattice(spark, n, k // 2, 1)
    moved = F.when(rand.uniform(seed, F.lit("move"), "src", "dst") < p, rand.uniform_int(0, n - 1, seed, F.lit("end"), "src", "dst")).otherwise(F.col("dst"))
    pairs = base.select("src", moved.alias("dst"))
    return _weighted(cleaned(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(1).alias("weight"))), weight, seed)


def cycle(spark: SparkSession, n: int, weight: int | tuple[int, int] = 100, seed: int = 0) -> DataFrame:
    return _weighted(spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")), weight, seed)


def path(spark: SparkSession, n: int, weight: int | tuple[int, int] = 100, seed: int = 0) -> DataFrame:
    return _weighted(spark.range(max(n - 1, 0)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), weight, seed)


def star(spark: SparkSession, leaves: int, weight: int | tuple[int, int] = 100, seed: int = 0) -> DataFrame:
    return _weighted(spark.range(1, leaves + 1).select(F.lit(0).alias("src"), F.col("id").alias("dst")), weight, seed)


def wheel(spark: SparkSession, n: int, weight: int | tuple[int, int] = 100, seed: int = 0) -> DataFrame:
    """A hub 0 and a rim of the other n - 1 vertices."""
    rim = spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") % (n - 1) + 1).alias("dst"))
    return _weighted(rim.union(spark.range(1, n).select(F.lit(0), "id")), weight, seed)


def _shifted(df: DataFrame, by: int) -> DataFrame:
    return df.select((F.col("src") + by).alias("src"), (F.col("dst") + by).alias("dst"))


def barbell(spark: SparkSession, clique: int, between: int = 0, weight: int | tuple[int, int] = 100, seed: int = 0) -> DataFrame:
    """Two cliques joined by a path of between vertices."""
    chain = _shifted(path(spark, between + 2), clique - 1)
    return _weighted(_pairs(spark, clique).union(chain).union(_shifted(_pairs(spark, clique), clique + between)), weight, seed)


def lollipop(spark: SparkSession, clique: int, tail: int, weight: int | tuple[int, int] = 100, seed: int = 0) -> DataFrame:
    """A clique with a path of tail vertices."""
    return _weighted(_pairs(spark, clique).union(_shifted(path(spark, tail + 1), clique - 1)), weight, seed)


def grid(spark: SparkSession, rows: int, columns: int, weight: int | tuple[int, int] = 100, seed: int = 0) -> DataFrame:
    """Vertex r * columns + c beside its right and lower neighbours."""
    cells = spark.range(rows * columns).select("id", (F.col("id") % columns).alias("c"))
    right = cells.filter(F.col("c") < columns - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = cells.filter(F.col("id") < (rows - 1) * columns).select(F.col("id").alias("src"), (F.col("id") + columns).alias("dst"))
    return _weighted(right.union(down), weight, seed)


def caveman(spark: SparkSession, cliques: int, size: int, weight: int | tuple[int, int] = 100, seed: int = 0) -> DataFrame:
    """Connected caveman graph: of each clique one edge is rewired to the next clique."""
    members = spark.range(cliques).crossJoin(F.broadcast(_pairs(spark, size))) if size * size <= 1_000_000 else None
    if members is None:
        raise ValueError("cliques of more than 1000 vertices are not supported")
    pairs = members.select((F.col("id") * size + F.col("src")).alias("src"), F.when((F.col("src") == 0) & (F.col("dst") == 1), F.pmod(F.col("id") * size - 1, F.lit(cliques * size))).otherwise(F.col("id") * size + F.col("dst")).alias("dst"))
    return _weighted(pairs, weight, seed)


def random_regular(spark: SparkSession, n: int, degree: int, weight: int | tuple[int, int] = 100, seed: int = 0) -> DataFrame:
    """A degree-regular multigraph without loops (degree even): the union of degree / 2 random Hamiltonian cycles, each the order of the vertices by a hash. Parallel edges may occur."""
    if degree % 2:
        raise ValueError("degree must be even")
    from ..operators.edges import ranked

    out: DataFrame | None = None
    for i in range(degree // 2):
        order = ranked(spark.range(n).select("id", rand.uniform(seed, F.lit(i), "id").alias("u")), ["u", "id"], "place").select("id", "place")
        follow = order.select(F.col("id").alias("dst"), F.pmod(F.col("place") - 1, F.lit(n)).alias("place"))
        pairs = order.join(follow, "place").select(F.col("id").alias("src"), "dst")
        out = pairs if out is None else out.union(pairs)
    return _weighted(out if out is not None else _pairs(spark, 0), weight, seed)


def preferential_attachment(spark: SparkSession, n: int, m: int, weight: int | tuple[int, int] = 100, seed: int = 0, hops: int = 24) -> DataFrame:
    """Each new vertex joins m earlier ones with a probability that grows with their degree; loops and repetitions are dropped.

    The k-th edge end copies the end at a hashed earlier place, and a copied new end is that end's vertex: following the copies back takes no order of
    execution, so all edges arise in parallel.
    """
    ends = spark.range(n * m).select("id", F.floor(F.col("id") / m).cast("long").alias("src"))
    # places 2e (the new vertex of edge e) and 2e + 1 (its target); a target copies a place up to 2e
    back = lambda at, _: F.when(at % 2 == 1, F.floor(rand.uniform(seed, at) * at)).otherwise(at)
    place = F.aggregate(F.sequence(F.lit(1), F.lit(hops)), (2 * F.col("id") + 1).cast("long"), back)
    found = ends.select("src", F.floor(F.floor(place / 2) / m).alias("dst"))
    return _weighted(cleaned(found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(1).alias("weight"))), weight, seed)


def rmat(spark: SparkSession, n: int, m: int, a: float = 0.45, b: float = 0.22, c: float = 0.22, weight: int | tuple[int, int] = 1, seed: int = 0) -> DataFrame:
    """Recursive-matrix graph: m draws of a cell, one hashed quadrant a bit; cells outside n, loops and repetitions are dropped."""
    bits = max(1, (n - 1).bit_length())

    def side(u: Column, low: float, high: float, third: float | None = None) -> Column:
        test = (u >= low) & (u < high)
        return F.when(test | (u >= third) if third is not None else test, 1).otherwise(0)

    src: Column = F.lit(0).cast("long")
    dst: Column = F.lit(0).cast("long")
    for bit in range(bits):
        u = rand.uniform(seed, F.lit(bit), "id")
        src = src * 2 + F.when(u >= a + b, 1).otherwise(0)
        dst = dst * 2 + side(u, a, a + b, a + b + c)
    draws = spark.range(m).select(src.alias("src"), dst.alias("dst")).filter((F.col("src") < n) & (F.col("dst") < n))
    return _weighted(cleaned(draws.withColumn("weight", F.lit(1))), weight, seed)


def verification_suite(spark: SparkSession, n: int = 8000, seed: int = 0) -> dict[str, DataFrame]:
    """Graphs of known cuts, at the proportions of a size n."""
    return {
        "barbell": barbell(spark, n // 50, n // 50), "grid": grid(spark, n // 50, n // 50), "lollipop": lollipop(spark, n // 20, n // 10), "star": star(spark, n),
        "wheel": wheel(spark, n), "small_world": small_world(spark, n, 8, 0.1, seed=seed), "caveman": caveman(spark, 5, n // 20),
    }


def density_suite(spark: SparkSession, n: int = 8000, degrees: tuple[int, ...] = (16, 32, 64, 128, 256, 512, 1024, 2048), seed: int = 0) -> dict[int, DataFrame]:
    """Random regular graphs of growing density."""
    return {k: random_regular(spark, n, k, seed=seed) for k in degrees}


def rmat_suite(spark: SparkSession, sizes: list[tuple[int, int]], seed: int = 0) -> dict[tuple[int, int], DataFrame]:
    """R-MAT graphs by (vertices, degree)."""
    return {(n, d): rmat(spark, n, n * d, seed=seed) for n, d in sizes}
