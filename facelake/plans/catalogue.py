"""The registered queries and the SQL that must give the same rows.

The tables of the test data stand in for collections (`embeddings`), detected faces (`lineitem`: an order
is an image, a line a face with area quantity x price and score tax), files (`pages`, `documents`) and
request parameters (`orders`, `events`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facelake.functions import strings, vectors
from facelake.operators import faces
from facelake.operators.collections import STAMP, condition
from facelake.operators.search import search, search_many
from facelake.session import ship, stored

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query of (read, spark) with its SQL."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark)

        run.__name__, run.__doc__ = name, function.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


def big(column: Column) -> Column:
    return column.cast("bigint")


def first_of_line() -> list[Column]:
    """What makes the earlier of equal lines the greater."""
    return [-F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]


def faces_of(read) -> DataFrame:
    """Each order's lines as detected faces in a fixed order."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax")
    lists = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    zero = F.lit(0.0)
    face = F.transform(
        "lines",
        lambda x: F.struct(
            F.array(zero, zero, x["l_quantity"], x["l_extendedprice"]).alias("box"),
            F.array(*[F.array(zero, zero)] * 5).alias("landmarks"),
            x["l_tax"].alias("score"),
            x["l_partkey"].alias("part"),
        ),
    )
    return lists.select("l_orderkey", face.alias("faces"))


def vector_of(rows: DataFrame, key: int) -> list[float]:
    """A request's query vector."""
    found = rows.where(F.col("vec_id") == key).select("embedding").first()
    if found is None:
        raise KeyError(f"no vector {key}")
    return found[0]


def grey(x: Column) -> Column:
    """A component from -1 to 1 as a pixel's value, in floats as the vectors are: whole numbers would make doubles of them, which
    now and then fall on the other side of a whole number."""
    one, most = (F.lit(float(n)).cast("float") for n in (1, 127))
    return F.floor((x + one) * most)


def grey_images(read) -> DataFrame:
    """Each vector as an 8 x 8 grey image, as the image source would give it."""
    pixel = F.transform("embedding", lambda x: F.lpad(F.hex(grey(x).cast("long")), 2, "0"))
    return read("embeddings").select(
        F.col("vec_id").cast("string").alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"),
        F.unhex(F.array_join(pixel, "")).alias("data"), F.lit("ok").alias("status"), "vec_id", "label", "embedding",
    )


#: The same images' values in SQL, from -1 to 1.
GREY = "SELECT vec_id, label, list_transform(embedding, lambda x: (floor((x + 1) * 127)::double / 255 - 0.5) / 0.5) AS v FROM embeddings"
COSINE = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query(
    "flat_cosine_topk",
    f"""SELECT b.vec_id AS id, round({COSINE}, 6) AS distance, b.label AS person_id FROM embeddings a, embeddings b
    WHERE a.vec_id = 0 ORDER BY {COSINE} DESC, b.vec_id LIMIT 5""",
)
def flat_cosine_topk(read, spark):
    """The five rows nearest to row 0."""
    e = read("embeddings")
    found = search(e, vector_of(e, 0), 5, ["label"], key="vec_id")
    return found.select(F.col("vec_id").alias("id"), F.round("distance", 6).alias("distance"), F.col("label").alias("person_id"))


@query(
    "batch_cosine_topk",
    f"""SELECT query_id, id, round(s, 6) AS distance, rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS id, {COSINE} AS s,
               row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS rank
        FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 5""",
)
def batch_cosine_topk(read, spark):
    """The five rows nearest to each row whose id is divisible by 20."""
    e = read("embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = search_many(e, q, 5, key="vec_id")
    return found.select("query_id", F.col("vec_id").alias("id"), F.round("distance", 6).alias("distance"), "rank")


@query(
    "tta_concat",
    """SELECT vec_id, len(v)::bigint AS dim, round(v[1], 6) AS head, round(v[128], 6) AS tail FROM (
        SELECT vec_id, list_concat(embedding, list_reverse(embedding))::double[] AS v FROM embeddings)""",
)
def tta_concat(read, spark):
    """Stored vectors of test-time augmentation, with the reversed vector for the flipped image."""
    v = vectors.with_flip(F.col("embedding"), F.reverse("embedding"))
    return read("embeddings").select(
        "vec_id", big(F.size(v)).alias("dim"), F.round(F.get(v, F.lit(0)).cast("double"), 6).alias("head"), F.round(F.get(v, F.lit(127)).cast("double"), 6).alias("tail")
    )


@query(
    "tta_cosine_topk",
    """WITH t AS (SELECT vec_id, list_concat(embedding, list_reverse(embedding))::double[] AS v FROM embeddings)
    SELECT b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS distance FROM t a, t b
    WHERE a.vec_id = 0 ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id LIMIT 5""",
)
def tta_cosine_topk(read, spark):
    e = read("embeddings").select("vec_id", vectors.with_flip(F.col("embedding"), F.reverse("embedding")).alias("embedding"))
    return search(e, vector_of(e, 0), 5, [], key="vec_id").select(F.col("vec_id").alias("id"), F.round("distance", 6).alias("distance"))


@query("query_filter_limit", "SELECT vec_id AS id, label AS person_id FROM embeddings WHERE label = 3 AND vec_id IN (SELECT vec_id FROM embeddings WHERE vec_id < 400) ORDER BY vec_id LIMIT 10")
def query_filter_limit(read, spark):
    """A filter in the vector database's language, projected and limited."""
    found = read("embeddings").where(condition("label == 3 && vec_id < 400")).orderBy("vec_id").limit(10)
    return found.select(F.col("vec_id").alias("id"), F.col("label").alias("person_id"))


@query("query_by_person", "SELECT vec_id AS id, label AS person_id FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 100")
def query_by_person(read, spark):
    found = read("embeddings").where(F.col("label") == F.lit(3)).orderBy("vec_id").limit(100)
    return found.select(F.col("vec_id").alias("id"), F.col("label").alias("person_id"))


@query(
    "collection_stats",
    """SELECT n.label AS collection, coalesce(s.n, 0)::bigint AS row_count, coalesce(s.dim, 0)::bigint AS dim
    FROM (SELECT unnest(range(12))::int AS label) n LEFT JOIN
    (SELECT label, count(*) AS n, max(len(embedding)) AS dim FROM embeddings GROUP BY label) s USING (label)""",
)
def collection_stats(read, spark):
    """Rows and vector length of each collection, 0 for missing ones."""
    names = spark.range(12).select(F.col("id").cast("int").alias("label"))
    stats = read("embeddings").groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))
    return names.join(stats, "label", "left").select(
        F.col("label").alias("collection"), F.coalesce("n", F.lit(0)).cast("bigint").alias("row_count"), F.coalesce("dim", F.lit(0)).cast("bigint").alias("dim")
    )


@query(
    "model_collection_lookup",
    """SELECT p_brand AS model, coalesce(c, 'fallback') AS collection, (c IS NOT NULL) AS known, count(*)::bigint AS n
    FROM part LEFT JOIN (VALUES ('Brand#11', 'first'), ('Brand#23', 'second')) m(b, c) ON b = p_brand GROUP BY 1, 2, 3""",
)
def model_collection_lookup(read, spark):
    """A model's collection, the fallback for unknown models."""
    models = spark.createDataFrame([("Brand#11", "first"), ("Brand#23", "second")], "b string, c string")  # two rows
    joined = read("part").join(F.broadcast(models), F.col("b") == F.col("p_brand"), "left")
    return joined.groupBy(F.col("p_brand").alias("model"), F.coalesce("c", F.lit("fallback")).alias("collection"), F.col("c").isNotNull().alias("known")).agg(F.count("*").alias("n"))


@query(
    "insert_zip_shortest",
    """SELECT d.doc_id::varchar AS image_path, l.quality::varchar AS person_id, d.place FROM
    (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents) d JOIN
    (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS place FROM labels) l USING (place)""",
)
def insert_zip_shortest(read, spark):
    """Two lists put together by place, as long as the shorter."""

    def placed(table, *columns):
        # ordered by range so that places are counted per partition, not in one task
        from facelake.operators.collections import numbered_rows

        rows = read(table).select(*columns).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        return numbered_rows(stored(rows.withColumn("at", F.monotonically_increasing_id()), "placed"), "at").drop("at")

    docs, labels = placed("documents", "doc_id"), placed("labels", "doc_id", "quality").drop("doc_id")
    return docs.join(labels, "number").select(
        F.col("doc_id").cast("string").alias("image_path"), F.col("quality").cast("string").alias("person_id"), F.col("number").alias("place")
    )


@query(
    "insert_auto_id",
    """SELECT vec_id AS id, label AS person_id FROM embeddings UNION ALL
    SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY vec_id), label FROM embeddings WHERE label < 3""",
)
def insert_auto_id(read, spark):
    """An append whose ids follow on."""
    from facelake.operators.collections import numbered_rows

    e = read("embeddings").select("vec_id", "label")
    new = e.where("label < 3").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    numbered = numbered_rows(stored(new.withColumn("at", F.monotonically_increasing_id()), "placed"), "at")
    top = e.agg(F.max("vec_id").alias("top"))  # one row
    added = numbered.join(F.broadcast(top)).select((F.col("top") + F.col("number")).alias("id"), F.col("label").alias("person_id"))
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("person_id")).unionByName(added)


@query("insert_created_at", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events")
def insert_created_at(read, spark):
    return read("events").select("event_id", F.date_format("ts", STAMP).alias("created_at"))


@query(
    "ingest_batches",
    """SELECT batch, count(*)::bigint AS n, min(vec_id) AS first_id, sum(count(*)) OVER (ORDER BY batch)::bigint AS total FROM
    (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 50 AS batch FROM embeddings) GROUP BY batch""",
)
def ingest_batches(read, spark):
    """Batches of fifty rows and what has been inserted after each."""
    from facelake.operators.collections import numbered_rows

    e = read("embeddings").select("vec_id").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    rows = numbered_rows(stored(e.withColumn("at", F.monotonically_increasing_id()), "placed"), "at")
    batches = rows.groupBy(F.floor((F.col("number") - 1) / 50).cast("bigint").alias("batch")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("number").alias("total"))
    return batches.select("batch", "n", "first_id", "total")


@query("list_sorted_limit", "SELECT page_id, url FROM pages ORDER BY string_split(url, '/'), page_id LIMIT 20")
def list_sorted_limit(read, spark):
    """Files by path components."""
    return read("pages").select("page_id", "url").orderBy(F.split("url", "/"), "page_id").limit(20)


@query(
    "person_id_from_path",
    """SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN string_split(substr(url, 9), '/')[1]
        ELSE string_split(url, '/')[-2] END AS person_id, string_split(url, '/')[-1] AS file FROM pages""",
)
def person_id_from_path(read, spark):
    """The first folder below a base, else the parent folder."""
    return read("pages").select("page_id", strings.person_id(F.col("url"), "https://").alias("person_id"), strings.basename(F.col("url")).alias("file"))


@query(
    "allowed_extension",
    """SELECT page_id, lower(regexp_extract(url, '\\.([^.]*)$', 1)) AS extension,
        (contains(url, '.') AND lower(regexp_extract(url, '\\.([^.]*)$', 1)) IN ('png', 'jpg', 'jpeg', 'bmp', 'tiff')) AS allowed FROM pages""",
)
def allowed_extension(read, spark):
    return read("pages").select("page_id", strings.extension(F.col("url")).alias("extension"), strings.allowed_file(F.col("url")).alias("allowed"))


@query(
    "secure_filename",
    r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(strip_accents(name), '[/\\]', ' ', 'g'),
        '[^\x00-\x7F]', '', 'g')), '\s+', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g'), '^[._]+|[._]+$', '', 'g') AS name
        FROM (SELECT 'page ' || page_id AS id, url AS name FROM pages UNION ALL SELECT 'document ' || doc_id, coalesce(text, '') FROM documents)""",
)
def secure_filename(read, spark):
    """Names of pages, and whole texts as names, which have accents."""
    pages = read("pages").select(F.concat(F.lit("page "), "page_id").alias("id"), F.col("url").alias("name"))
    texts = read("documents").select(F.concat(F.lit("document "), "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("name"))
    return pages.unionByName(texts).select("id", strings.secure_filename(F.col("name")).alias("name"))


@query(
    "bool_and_int_params",
    """SELECT o_orderkey, coalesce(lower(CASE WHEN o_orderstatus = 'O' THEN 'True' WHEN o_orderstatus = 'F' THEN 'no' END) = 'true', true) AS detect,
        CASE WHEN o_orderpriority IS NULL THEN 5 ELSE try_cast(substr(o_orderpriority, 1, 1) AS int) END AS top_k FROM orders""",
)
def bool_and_int_params(read, spark):
    """Request parameters with their defaults."""
    asked = F.when(F.col("o_orderstatus") == "O", "True").when(F.col("o_orderstatus") == "F", "no")
    k = F.substring("o_orderpriority", 1, 1)
    return read("orders").select("o_orderkey", strings.flag(asked, True).alias("detect"), strings.integer(k, 5).alias("top_k"))


@query(
    "batch_status_summary",
    """SELECT source, count(*)::bigint AS total, count_if(quality = 1)::bigint AS successful, count_if(quality IS NULL OR quality = 0)::bigint AS failed,
        count_if(quality IS NULL)::bigint AS no_face_detected FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def batch_status_summary(read, spark):
    """Outcomes of each batch of files."""
    joined = read("documents").select("doc_id", "source").join(read("labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.col("quality")
    return joined.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(q == 1).alias("successful"), F.count_if(q.isNull() | (q == 0)).alias("failed"), F.count_if(q.isNull()).alias("no_face_detected")
    )


@query(
    "insert_error_report",
    """SELECT conv_id, coalesce(string_agg(turn || ':' || role, '; ' ORDER BY turn, role) FILTER (WHERE length(text) < 200), '') AS errors,
        count_if(length(text) < 50)::bigint AS no_face_count FROM conversations GROUP BY conv_id""",
)
def insert_error_report(read, spark):
    """Errors of a request in the order of its files."""
    rows = read("conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    entry = F.when(F.col("n") < 200, F.struct("turn", "role"))
    found = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.count_if(F.col("n") < 50).alias("no_face_count"))
    text = F.transform("e", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"]))
    return found.select("conv_id", F.array_join(text, "; ").alias("errors"), "no_face_count")


@query(
    "similarity_percent",
    f"""SELECT b.vec_id AS id, printf('%.2f%%', {COSINE} * 100) AS similarity,
        row_number() OVER (ORDER BY {COSINE} DESC, b.vec_id) AS rank
    FROM embeddings a, embeddings b WHERE a.vec_id = 1 ORDER BY rank LIMIT 5""",
)
def similarity_percent(read, spark):
    """Ranked hits with their similarity as text."""
    e = read("embeddings")
    hits = search(e, vector_of(e, 1), 5, [], key="vec_id")
    order = Window.orderBy(F.desc("distance"), "vec_id")  # five rows
    return hits.select(F.col("vec_id").alias("id"), strings.percent(F.col("distance")).alias("similarity"), F.row_number().over(order).cast("bigint").alias("rank"))


@query(
    "largest_face",
    """SELECT l_orderkey, l_partkey AS part, round(l_quantity * l_extendedprice, 2) AS area, l_tax AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity * l_extendedprice DESC, l_tax DESC,
            l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem WHERE l_quantity * l_extendedprice > 0) WHERE r = 1""",
)
def largest_face(read, spark):
    """The largest face of each image."""
    area = F.col("l_quantity") * F.col("l_extendedprice")
    rows = read("lineitem").where(area > 0)
    return faces.best_rows(rows, "l_orderkey", [area, F.col("l_tax"), *first_of_line()], [F.col("l_partkey").alias("part"), F.round(area, 2).alias("area"), F.col("l_tax").alias("score")])


@query(
    "most_confident_face",
    """SELECT l_orderkey, l_partkey AS part, l_tax AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r
        FROM lineitem) WHERE r = 1""",
)
def most_confident_face(read, spark):
    values = [F.col("l_partkey").alias("part"), F.col("l_tax").alias("score")]
    return faces.best_rows(read("lineitem"), "l_orderkey", [F.col("l_tax"), *first_of_line()], values)


@query(
    "detection_info",
    """SELECT l_orderkey, count(*)::bigint AS num_faces, count_if(l_tax >= 0.04)::bigint AS usable, max(l_tax) AS best_score,
        array_to_string(list(l_partkey ORDER BY l_tax DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice), ',') AS parts FROM lineitem GROUP BY l_orderkey""",
)
def detection_info(read, spark):
    """Faces of an image by falling score, and how many pass the threshold."""
    f = faces_of(read).withColumn("ranked", faces.ranked(F.col("faces")))
    return f.select(
        "l_orderkey",
        F.size("faces").cast("bigint").alias("num_faces"),
        F.size(faces.usable(F.col("faces"), 0.04)).cast("bigint").alias("usable"),
        F.col("ranked")[0]["score"].alias("best_score"),
        F.array_join(F.transform("ranked", lambda x: x["part"].cast("string")), ",").alias("parts"),
    )


@query(
    "similarity_fit",
    """WITH p AS (SELECT l_orderkey, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 / 3 AS u, l_linenumber::double / 7 AS v FROM lineitem),
    s AS (SELECT l_orderkey, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM p GROUP BY 1),
    f AS (SELECT p.l_orderkey, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) AS d, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) AS c,
        sum((x - mx) ** 2 + (y - my) ** 2) AS q FROM p JOIN s USING (l_orderkey) GROUP BY 1)
    SELECT l_orderkey, round(d / q, 7) + 0.0 AS a, round(c / q, 7) + 0.0 AS b, round(mu - d / q * mx + c / q * my, 7) + 0.0 AS tx,
        round(mv - c / q * mx - d / q * my, 7) + 0.0 AS ty FROM f JOIN s USING (l_orderkey) WHERE n >= 5""",
)
def similarity_fit(read, spark):
    """The similarity that maps each image's landmarks to their places best."""
    p = read("lineitem").select(
        "l_orderkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100 / 3).alias("u"), (F.col("l_linenumber").cast("double") / 7).alias("v")
    )
    fit = faces.fit_similarity(p, "l_orderkey", "x", "y", "u", "v").where("n >= 5")
    return fit.select("l_orderkey", *[(F.round(F.col(c), 7) + 0.0).alias(c) for c in ("a", "b", "tx", "ty")])


@query(
    "reference_points",
    """WITH r(i, x, y) AS (VALUES (0, 38.2946, 51.6963), (1, 73.5318, 51.5014), (2, 56.0252, 71.7366), (3, 41.5493, 92.3655), (4, 70.7299, 92.2041)),
    s AS (SELECT p_partkey, p_size * 16 AS size FROM part)
    SELECT p_partkey, i AS point, round(CASE WHEN size % 112 <> 0 AND size % 128 = 0 THEN (x::double + 8) * size / 128 ELSE x::double * size / 112 END, 4) AS x,
        round(CASE WHEN size % 112 <> 0 AND size % 128 = 0 THEN y::double * size / 128 ELSE y::double * size / 112 END, 4) AS y FROM r, s""",
)
def reference_points(read, spark):
    """A face's reference points in an image of each part's size."""
    points = F.posexplode(faces.reference_array(F.col("p_size") * 16)).alias("point", "at")
    return read("part").select("p_partkey", points).select("p_partkey", "point", *[F.round(F.get("at", F.lit(i)), 4).alias(n) for i, n in enumerate("xy")])


@query(
    "landmark_reshape",
    """SELECT vec_id, i AS point, round(embedding[2 * i + 1]::double, 6) AS x, round(embedding[2 * i + 2]::double, 6) AS y
    FROM embeddings, (SELECT unnest(range(5))::int AS i)""",
)
def landmark_reshape(read, spark):
    points = read("embeddings").select("vec_id", F.posexplode(faces.landmark_points(F.col("embedding"))).alias("point", "p"))
    return points.select("vec_id", "point", F.round(F.col("p")[0].cast("double"), 6).alias("x"), F.round(F.col("p")[1].cast("double"), 6).alias("y"))


def elementwise(expression: str) -> str:
    """SQL for one row of (vec_id, i, value) for each value x of each vector."""
    return f"SELECT vec_id, i, round({expression}, 6) + 0.0 AS value FROM (SELECT vec_id, unnest(range(64))::int AS i, unnest(embedding)::double AS x FROM embeddings)"


def unnested(rows: DataFrame, values: Column) -> DataFrame:
    return rows.select("vec_id", F.posexplode(values).alias("i", "v")).select("vec_id", "i", (F.round(F.col("v").cast("double"), 6) + 0.0).alias("value"))


@query("pixel_normalise", elementwise("(x * 255 / 255.0 - 0.5) / 0.5"))
def pixel_normalise(read, spark):
    return unnested(read("embeddings"), vectors.normalise_pixels(F.transform("embedding", lambda x: x.cast("double") * 255)))


@query(
    "horizontal_flip",
    """SELECT vec_id, i, round(embedding[(i // 8) * 8 + 8 - i % 8]::double, 6) + 0.0 AS value FROM embeddings, (SELECT unnest(range(64))::int AS i)""",
)
def horizontal_flip(read, spark):
    """Vectors as 8 x 8 images, mirrored."""
    return unnested(read("embeddings"), vectors.flip_rows(F.col("embedding"), 8))


@query("activations", elementwise("x * greatest(0, least(1, x / 6 + 0.5)) + CASE WHEN x >= 0 THEN x ELSE x * 0.25 END"))
def activations(read, spark):
    values = F.transform("embedding", lambda x: vectors.hard_swish(x.cast("double")) + vectors.prelu(x.cast("double")))
    return unnested(read("embeddings"), values)


@query(
    "squeeze_excite_scale",
    """SELECT vec_id, i, round(x * greatest(0, least(1, m / 6 + 0.5)), 6) + 0.0 AS value FROM (
        SELECT vec_id, i, x, avg(x) OVER (PARTITION BY vec_id, i // 8) AS m FROM
        (SELECT vec_id, unnest(range(64))::int AS i, unnest(embedding)::double AS x FROM embeddings))""",
)
def squeeze_excite_scale(read, spark):
    return unnested(read("embeddings"), vectors.squeeze_excite(F.col("embedding"), 8))


def seeded_weights(spark, salt: int, **sizes: int) -> DataFrame:
    """A weights table with these index columns, for layers without weights at hand: sines of the indices."""
    rows = spark.range(1).select(F.lit(float(salt)).alias("at"))
    for step, (name, n) in enumerate(sizes.items(), 2):
        rows = rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("at", F.col("at") * step + F.col(name))
    return rows.select(*sizes, (F.sin("at") / 2).alias("w"))


def seeded_sql(salt: int, **sizes: int) -> str:
    """The same table in SQL."""
    at = f"{salt}::double"
    for step, name in enumerate(sizes, 2):
        at = f"({at}) * {step} + {name}"
    return f"SELECT {', '.join(sizes)}, sin({at}) / 2 AS w FROM " + ", ".join(f"(SELECT unnest(range({n}))::int AS {name})" for name, n in sizes.items())


def seeded_norm(spark, n: int) -> DataFrame:
    c = F.col("id").cast("int")
    return spark.range(n).select(c.alias("c"), (1 + c / 10).alias("gamma"), (c / 20).alias("beta"), (c / 30).alias("mean"), (1 + c / 5).alias("var"))


def norm_sql(source: str) -> str:
    return f"SELECT * REPLACE ((v - c / 30) / sqrt(1 + c / 5 + 1e-5::double) * (1 + c / 10) + c / 20 AS v) FROM {source}"


def conv_sql(source: str, weights: str, out: int, stride: int = 1, padding: int = 0, depthwise: bool = False) -> str:
    y, x = (f"({a} + {padding} - k{a})" for a in "yx")
    return f"""SELECT image, o AS c, {y} // {stride} AS y, {x} // {stride} AS x, sum(v * w) AS v FROM {source} JOIN ({weights}) ON c = {"o" if depthwise else "i"}
        WHERE {y} >= 0 AND {x} >= 0 AND {y} % {stride} = 0 AND {x} % {stride} = 0 AND {y} < {out * stride} AND {x} < {out * stride} GROUP BY ALL"""


MAPS_SQL = "SELECT vec_id AS image, 0 AS c, (p // 8)::int AS y, (p % 8)::int AS x, v FROM (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding)::double AS v FROM embeddings)"
SUMS_SQL = "SELECT image AS vec_id, c, round(sum(v), 5) + 0.0 AS total, round(sum(v * (y * 8 + x)), 4) + 0.0 AS weighted FROM {} GROUP BY ALL"


def map_sums(maps: DataFrame) -> DataFrame:
    at = F.col("y") * 8 + F.col("x")
    return maps.groupBy(F.col("image").alias("vec_id"), "c").agg((F.round(F.sum("v"), 5) + 0.0).alias("total"), (F.round(F.sum(F.col("v") * at), 4) + 0.0).alias("weighted"))


CONV_BLOCK_SQL = f"""maps AS ({MAPS_SQL}), conv AS ({conv_sql("maps", seeded_sql(1, o=4, i=1, ky=3, kx=3), 8, 1, 1)}), normed AS ({norm_sql("conv")}),
    block AS (SELECT * REPLACE (CASE WHEN v >= 0 THEN v ELSE v * (0.25::double + c / 100) END AS v) FROM normed)"""


def conv_block_maps(read, spark) -> DataFrame:
    from facelake.operators import network

    maps = network.maps_of(read("embeddings"), "vec_id", "embedding", 8)
    slopes = spark.range(4).select(F.col("id").cast("int").alias("c"), (0.25 + F.col("id") / 100).alias("slope"))
    conv = network.conv2d(maps, seeded_weights(spark, 1, o=4, i=1, ky=3, kx=3), 8, padding=1, kernel=3)
    return network.prelu(network.batch_norm(conv, seeded_norm(spark, 4)), slopes)


@query("conv_block", f"WITH {CONV_BLOCK_SQL} {SUMS_SQL.format('block')}")
def conv_block(read, spark):
    """Vectors as 8 x 8 images through a convolution, its normalisation and a slope for each channel."""
    return map_sums(conv_block_maps(read, spark))


GATED = "greatest(0, least(1, ({}) / 6 + 0.5))"


@query(
    "inverted_residual",
    f"""WITH {CONV_BLOCK_SQL},
    e AS ({norm_sql("(" + conv_sql("block", seeded_sql(2, o=6, i=4, ky=1, kx=1), 8) + ")")}), wide AS (SELECT * REPLACE (v * {GATED.format("v")} AS v) FROM e),
    d AS ({norm_sql("(" + conv_sql("wide", seeded_sql(3, o=6, ky=3, kx=3), 8, 1, 1, True) + ")")}), deep AS (SELECT * REPLACE (v * {GATED.format("v")} AS v) FROM d),
    pooled AS (SELECT image, c, avg(v) AS v FROM deep GROUP BY ALL),
    hidden AS (SELECT image, o AS c, greatest(0, sum(v * w) + o / 10) AS v FROM pooled JOIN ({seeded_sql(4, o=2, i=6)}) ON c = i GROUP BY image, o),
    gate AS (SELECT image, o AS c, {GATED.format("sum(v * w) + o / 10")} AS g FROM hidden JOIN ({seeded_sql(5, o=6, i=2)}) ON c = i GROUP BY image, o),
    gated AS (SELECT deep.* REPLACE (v * g AS v) FROM deep JOIN gate USING (image, c)),
    p AS ({norm_sql("(" + conv_sql("gated", seeded_sql(6, o=4, i=6, ky=1, kx=1), 8) + ")")}),
    out AS (SELECT p.image, c, y, x, p.v + block.v AS v FROM p JOIN block USING (image, c, y, x))
    {SUMS_SQL.format("out")}""",
)
def inverted_residual(read, spark):
    """A gated bottleneck block with its residual, on the maps of conv_block."""
    from facelake.operators import network

    def bias(n):
        return spark.range(n).select(F.col("id").cast("int").alias("c"), (F.col("id") / 10).alias("b"))

    block = {
        "expand": seeded_weights(spark, 2, o=6, i=4, ky=1, kx=1), "expand_norm": seeded_norm(spark, 6), "deep": seeded_weights(spark, 3, o=6, ky=3, kx=3), "deep_norm": seeded_norm(spark, 6),
        "first": (seeded_weights(spark, 4, o=2, i=6), bias(2)), "second": (seeded_weights(spark, 5, o=6, i=2), bias(6)),
        "project": seeded_weights(spark, 6, o=4, i=6, ky=1, kx=1), "project_norm": seeded_norm(spark, 4), "residual": True,
    }
    maps = stored(conv_block_maps(read, spark), "maps")
    maps = network.dealt(maps, maps.count())
    return map_sums(network.inverted_residual(maps, block, 8, 1, 3, vectors.hard_swish, vectors.hard_sigmoid))


@query(
    "embedding_head",
    f"""WITH {CONV_BLOCK_SQL}, deep AS ({norm_sql("(" + conv_sql("block", seeded_sql(7, o=4, ky=8, kx=8), 1, 1, 0, True) + ")")}),
    line AS (SELECT image, o AS c, sum(v * w) AS v FROM deep JOIN ({seeded_sql(8, o=16, i=4)}) ON c = i GROUP BY ALL)
    SELECT image AS vec_id, c, round(v, 5) + 0.0 AS value FROM ({norm_sql("line")})""",
)
def embedding_head(read, spark):
    """The maps of conv_block as vectors: a kernel as large as the map, and a linear layer, both normalised."""
    from facelake.operators import network

    maps = conv_block_maps(read, spark)
    found = network.head(maps, seeded_weights(spark, 7, o=4, ky=8, kx=8), seeded_norm(spark, 4), seeded_weights(spark, 8, o=16, i=4), seeded_norm(spark, 16), 8)
    return found.select(F.col("image").alias("vec_id"), "c", (F.round("v", 5) + 0.0).alias("value"))


@query(
    "channel_rounding",
    """SELECT p_partkey, (CASE WHEN n < 0.9 * v THEN n + 8 ELSE n END)::bigint AS channels FROM (
        SELECT p_partkey, v, greatest(8, floor((v + 4) / 8) * 8) AS n FROM (SELECT p_partkey, p_size * 1.5::double AS v FROM part))""",
)
def channel_rounding(read, spark):
    return read("part").select("p_partkey", vectors.rounded_channels(F.col("p_size") * 1.5).alias("channels"))


@query("json_paths", """SELECT event_id, (props->>'$.k')::bigint AS k, (json_extract(props, '$.k') IS NOT NULL) AS given FROM events""")
def json_paths(read, spark):
    """A parsed JSON parameter that survives being written again."""
    parsed = F.from_json("props", "k bigint")
    again = F.from_json(F.to_json(parsed), "k bigint")
    return read("events").select("event_id", again["k"].alias("k"), again["k"].isNotNull().alias("given"))


@query(
    "json_string_list",
    """SELECT page_id, len(parts)::bigint AS n, parts[len(parts)] AS last, (len(parts) > 3) AS deep FROM (SELECT page_id, string_split(url, '/') AS parts FROM pages)""",
)
def json_string_list(read, spark):
    """A request's list of names as JSON text, parsed again."""
    text = read("pages").select("page_id", F.to_json(F.split("url", "/")).alias("asked"))
    parts = text.select("page_id", F.from_json("asked", "array<string>").alias("parts"))
    return parts.select("page_id", F.size("parts").cast("bigint").alias("n"), F.element_at("parts", -1).alias("last"), (F.size("parts") > 3).alias("deep"))


@query(
    "consistency_check",
    """SELECT label, true AS same, count(*)::bigint AS n, sum(list_sum(list_transform(embedding, lambda x: floor((x + 1) * 127)::bigint)))::bigint AS total
    FROM embeddings GROUP BY label""",
)
def consistency_check(read, spark):
    """Whether an image's tensor is the same when decoded from its bytes and when taken from its values."""
    from facelake.operators.embed import tensors

    decoded = tensors(grey_images(read), 8)
    values = vectors.normalise_pixels(F.transform("embedding", grey))
    apart = F.zip_with(F.slice("tensor", 1, 64), values, lambda a, b: F.abs(a - b))
    same = (F.size("tensor") == 192) & (F.array_max(apart) < 1e-6)
    total = F.aggregate(F.slice("tensor", 65, 64), F.lit(0).cast("bigint"), lambda t, x: t + F.round((x * 0.5 + 0.5) * 255).cast("bigint"))
    return decoded.groupBy("label").agg(F.bool_and(same).alias("same"), F.count("*").alias("n"), F.sum(total).alias("total"))


@query("tensor_range", f"""SELECT vec_id, round(list_min(v), 5) AS low, round(list_max(v), 5) AS high FROM ({GREY})""")
def tensor_range(read, spark):
    """The least and the greatest value of each image's tensor."""
    from facelake.operators.embed import tensors

    t = F.transform("tensor", lambda x: x.cast("double"))
    return tensors(grey_images(read), 8).select("vec_id", F.round(F.array_min(t), 5).alias("low"), F.round(F.array_max(t), 5).alias("high"))


@query(
    "tta_halves_topk",
    f"""SELECT b.vec_id AS id, round({COSINE}, 6) AS distance FROM embeddings a, embeddings b
    WHERE a.vec_id = 2 ORDER BY {COSINE} DESC, b.vec_id LIMIT 5""",
)
def tta_halves_topk(read, spark):
    """Search where the halves of the augmented vector are stored apart."""
    e = read("embeddings")
    q = vector_of(e, 2)
    halves = e.select("vec_id", F.slice("embedding", 1, 32).alias("plain"), F.slice("embedding", 33, 32).alias("flipped"))
    score = vectors.cosine_of_halves(F.col("plain"), F.col("flipped"), vectors.literal(q[:32]), vectors.literal(q[32:]))
    found = halves.select("vec_id", score.alias("s")).orderBy(F.desc_nulls_last("s"), "vec_id").limit(5)
    return found.select(F.col("vec_id").alias("id"), F.round("s", 6).alias("distance"))


def found_sql(candidates: str, confidence: float) -> str:
    """SQL for kept(o, faces) from candidates (o, h, w, place, prior, score, loc, marks): decoding and greedy suppression, a
    candidate at a time. To be used behind WITH RECURSIVE."""
    both = "greatest(0, least(f.x1, k.x1) - greatest(f.x0, k.x0) + 1) * greatest(0, least(f.y1, k.y1) - greatest(f.y0, k.y0) + 1)"
    one, other = ("(%s.x1 - %s.x0 + 1) * (%s.y1 - %s.y0 + 1)" % ((n,) * 4) for n in "fk")
    return f"""c AS ({candidates}),
    levels AS (SELECT *, ceil(w / 8)::bigint AS c1, ceil(w / 16)::bigint AS c2, ceil(w / 32)::bigint AS c3 FROM c),
    counts AS (SELECT *, ceil(h / 8)::bigint * c1 * 2 AS n1, ceil(h / 16)::bigint * c2 * 2 AS n2, ceil(h / 32)::bigint * c3 * 2 AS n3 FROM levels),
    spots AS (SELECT *, CASE WHEN prior < n1 THEN prior WHEN prior < n1 + n2 THEN prior - n1 ELSE prior - n1 - n2 END AS i,
        CASE WHEN prior < n1 THEN 8 WHEN prior < n1 + n2 THEN 16 ELSE 32 END AS stride,
        CASE WHEN prior < n1 THEN c1 WHEN prior < n1 + n2 THEN c2 ELSE c3 END AS columns,
        CASE WHEN prior < n1 THEN 16 WHEN prior < n1 + n2 THEN 64 ELSE 256 END AS least
        FROM counts WHERE prior >= 0 AND prior < n1 + n2 + n3 AND score >= {confidence}),
    priors AS (SELECT *, (i // 2 % columns + 0.5) * stride / w AS cx, (i // 2 // columns + 0.5) * stride / h AS cy,
        least * (1 + i % 2) / w::double AS pw, least * (1 + i % 2) / h::double AS ph FROM spots),
    sized AS (SELECT *, cx + loc[1] * 0.1::double * pw AS x, cy + loc[2] * 0.1::double * ph AS y, pw * exp(loc[3] * 0.2::double) AS bw, ph * exp(loc[4] * 0.2::double) AS bh FROM priors),
    k AS (SELECT o, score, (x - bw / 2) * w AS x0, (y - bh / 2) * h AS y0, (x + bw / 2) * w AS x1, (y + bh / 2) * h AS y1,
        (cx + marks[1] * 0.1::double * pw) * w AS eye, row_number() OVER (PARTITION BY o ORDER BY score DESC, place, prior, loc, marks) AS r FROM sized),
    steps(o, r, faces) AS (
        SELECT DISTINCT o, 0::bigint, []::STRUCT(x0 double, y0 double, x1 double, y1 double, score double, eye double)[] FROM k UNION ALL
        SELECT k.o, k.r, CASE WHEN len(list_filter(faces, lambda f: ({both}) / ({one} + {other} - ({both})) > 0.4)) > 0 THEN faces
            ELSE list_append(faces, {{'x0': k.x0, 'y0': k.y0, 'x1': k.x1, 'y1': k.y1, 'score': k.score, 'eye': k.eye}}) END
        FROM steps JOIN k ON k.o = steps.o AND k.r = steps.r + 1),
    kept AS (SELECT o, arg_max(faces, r) AS faces FROM steps GROUP BY o),
    faces AS (SELECT o, f.i - 1 AS face_no, faces[f.i] AS f FROM kept, (SELECT unnest(range(1, 1000)) AS i) f WHERE f.i <= len(faces))"""


#: An image of 64 x 64 or 64 x 96 for each order, with a detector's raw outputs in its lines.
LINES_SQL = """SELECT l_orderkey AS o, 64::double AS h, 64::double + 32 * (l_orderkey % 2) AS w, l_linenumber AS place,
    (l_orderkey * 31 + l_linenumber % 3) % 260 AS prior, (l_suppkey % 50) / 50::double AS score,
    [l_discount * 20 - 1, l_tax * 20 - 0.8, l_quantity / 10 - 2.5, l_discount * l_quantity / 2]::double[] AS loc,
    [l_tax * 10, l_discount * 10, l_tax * 20, l_discount * 20, l_tax * 30, l_discount * 30, l_tax * 40, l_discount * 40, l_tax * 50, l_discount * 50]::double[] AS marks
    FROM lineitem"""


@query(
    "detect_raw_outputs",
    f"""WITH RECURSIVE {found_sql(LINES_SQL, 0.1)}
    SELECT o AS l_orderkey, face_no::int AS face_no, round(f.x0, 4) + 0.0 AS x0, round(f.y0, 4) + 0.0 AS y0, round(f.x1, 4) + 0.0 AS x1,
        round(f.y1, 4) + 0.0 AS y1, f.score AS score, round(f.eye, 4) + 0.0 AS eye FROM faces""",
)
def detect_raw_outputs(read, spark):
    """Boxes, scores and a landmark of each image's faces from a table of a detector's raw outputs."""
    from facelake.operators.detection import detect_rows

    d, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    # the few numbers of a line move, not what is made of them
    lines = read("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_tax", "l_quantity").repartition("l_orderkey")
    candidates = lines.select(
        "l_orderkey", F.col("l_linenumber").alias("place"), ((F.col("l_orderkey") * 31 + F.col("l_linenumber") % 3) % 260).alias("prior"),
        ((F.col("l_suppkey") % 50) / 50).alias("score"), F.array(d * 20 - 1, t * 20 - 0.8, q / 10 - 2.5, d * q / 2).alias("loc"),
        F.array(*[x * 10 * i for i in range(1, 6) for x in (t, d)]).alias("marks"),
    )
    width = F.lit(64.0) + 32 * (F.col("l_orderkey") % 2)
    found = detect_rows(candidates, "l_orderkey", F.lit(64.0), width, 0.1, ties=("place",))
    corner = [(F.round(F.get("box", F.lit(i)), 4) + 0.0).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return found.select("l_orderkey", "face_no", *corner, "score", (F.round(F.get(F.get("landmarks", F.lit(0)), F.lit(0)), 4) + 0.0).alias("eye"))


def raw_outputs(images: DataFrame) -> DataFrame:
    """images (.., embedding) with `faces`: each sixteen numbers of a vector are the outputs for one of the first four priors."""
    from facelake.operators.detection import candidates, detect

    def part(first: int, size: int) -> Column:
        return F.flatten(F.array(*[F.slice("embedding", 16 * i + first, size) for i in range(4)]))

    scores = F.transform(part(15, 1), lambda x: (x.cast("double") + 1) / 2)
    found = candidates(part(1, 4), scores, part(5, 10), 0.3)
    return images.withColumn("faces", detect(found, F.lit(8.0), F.lit(8.0), 0.3)).drop("embedding")


VECTORS_SQL = """SELECT vec_id AS o, 8::double AS h, 8::double AS w, i AS place, i AS prior, (embedding[16 * i + 15]::double + 1) / 2 AS score,
    embedding[16 * i + 1:16 * i + 4]::double[] AS loc, embedding[16 * i + 5:16 * i + 14]::double[] AS marks
    FROM embeddings, (SELECT unnest(range(4)) AS i)"""


@query(
    "detect_faces",
    f"""WITH RECURSIVE {found_sql(VECTORS_SQL, 0.3)}
    SELECT o AS vec_id, face_no::int AS face_no, round((f.x1 - f.x0) * (f.y1 - f.y0), 4) AS area, round(f.score, 6) AS score, round(f.eye, 5) AS eye
    FROM faces WHERE f.score >= 0.5""",
)
def detect_faces(read, spark):
    """All faces that a detector's outputs hold, one row each."""
    found = faces.explode_faces(raw_outputs(grey_images(read)), 0.5)
    eye = F.round(F.get(F.get("landmarks", F.lit(0)), F.lit(0)), 5)
    return found.select("vec_id", "face_no", F.round("area", 4).alias("area"), F.round("score", 6).alias("score"), eye.alias("eye"))


def pixels_sql(table: str) -> str:
    """SQL for (vec_id, total, weighted, low, high) of images in rows (vec_id, p, value)."""
    return f"""SELECT vec_id, sum(value)::bigint AS total, sum(value * (p % 97))::bigint AS weighted, min(value)::int AS low, max(value)::int AS high FROM {table} GROUP BY vec_id"""


def pixel_sums(pixels: DataFrame) -> DataFrame:
    """What pixels_sql tells of images in rows (vec_id, p, value)."""
    v = F.col("value")
    return pixels.groupBy("vec_id").agg(
        F.sum(v).cast("bigint").alias("total"), F.sum(v * (F.col("p") % 97)).cast("bigint").alias("weighted"), F.min(v).cast("int").alias("low"), F.max(v).cast("int").alias("high")
    )


def grey_values(read) -> DataFrame:
    """(vec_id, embedding, height, width, v): the values of the grey images."""
    v = F.transform("embedding", grey)
    return read("embeddings").select("vec_id", "embedding", F.lit(8).alias("height"), F.lit(8).alias("width"), v.alias("v"))


@query(
    "resize_112",
    f"""WITH a AS (SELECT i, s, w / sum(w) OVER (PARTITION BY i) AS w FROM (SELECT i, s, greatest(0, 1 - abs(s + 0.5 - (i + 0.5) * 8 / 112)) AS w
        FROM (SELECT unnest(range(112)) AS i), (SELECT unnest(range(8)) AS s)) WHERE w > 0),
    v AS (SELECT vec_id, place // 8 AS y, place % 8 AS x, floor((e + 1) * 127) AS value FROM (SELECT vec_id, unnest(range(64)) AS place, unnest(embedding) AS e FROM embeddings)),
    sums AS (SELECT vec_id, b.i * 112 + c.i AS p, sum(value * b.w * c.w) AS value FROM v JOIN a b ON b.s = y JOIN a c ON c.s = x GROUP BY 1, 2),
    pixels AS (SELECT vec_id, p, round_even(round(value, 6), 0) AS value FROM sums)
    {pixels_sql("pixels")}""",
)
def resize_112(read, spark):
    """Each image at 112 x 112: every pixel a weighted sum of its sources."""
    from facelake.functions.sampling import enlarged

    return pixel_sums(enlarged(grey_values(read).drop("embedding"), 112, 112))


@query(
    "warp_align",
    f"""WITH marks AS (SELECT vec_id, i, (embedding[2 * i - 1]::double + 1) * 4 AS x, (embedding[2 * i]::double + 1) * 4 AS y,
        [38.2946, 73.5318, 56.0252, 41.5493, 70.7299][i]::double AS u, [51.6963, 51.5014, 71.7366, 92.3655, 92.2041][i]::double AS v
        FROM embeddings, (SELECT unnest(range(1, 6)) AS i)),
    means AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM marks GROUP BY vec_id),
    fit AS (SELECT vec_id, mx, my, mu, mv, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) AS d, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) AS c,
        sum((x - mx) ** 2 + (y - my) ** 2) AS q FROM marks JOIN means USING (vec_id) GROUP BY ALL),
    m AS (SELECT vec_id, d / q AS a, c / q AS b, mu - d / q * mx + c / q * my AS tx, mv - c / q * mx - d / q * my AS ty FROM fit),
    spots AS (SELECT vec_id, p, (a * (p % 112 - tx) + b * (p // 112 - ty)) / (a * a + b * b) AS u, (a * (p // 112 - ty) - b * (p % 112 - tx)) / (a * a + b * b) AS v
        FROM m, (SELECT unnest(range(12544)) AS p)),
    near AS (SELECT vec_id, p, greatest(-2, least(9, u)) AS u, greatest(-2, least(9, v)) AS v FROM spots),
    corner AS (SELECT vec_id, p, floor(u)::int AS x, floor(v)::int AS y, u - floor(u) AS du, v - floor(v) AS dv FROM near),
    four AS (SELECT vec_id, p, x + i AS x, y + j AS y, CASE i WHEN 0 THEN 1 - du ELSE du END * CASE j WHEN 0 THEN 1 - dv ELSE dv END AS w
        FROM corner, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j)),
    sums AS (SELECT vec_id, p, sum(CASE WHEN x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 THEN w * floor((embedding[y * 8 + x + 1] + 1) * 127) ELSE 0 END) AS value
        FROM four JOIN embeddings USING (vec_id) GROUP BY 1, 2),
    pixels AS (SELECT vec_id, p, greatest(0, least(255, round_even(round(value, 6), 0))) AS value FROM sums)
    {pixels_sql("pixels")}""",
)
def warp_align(read, spark):
    """Each image moved so that its five points come to a face's reference points."""
    from facelake.functions.sampling import fitted, warped

    points = F.transform(faces.landmark_points(F.col("embedding")), lambda p: F.transform(p, lambda x: (x.cast("double") + 1) * 4))
    rows = grey_values(read).select("vec_id", "height", "width", "v", fitted(points, faces.reference_points(112)).alias("m"))
    return pixel_sums(warped(rows, 112))


@query(
    "embed_pixels",
    f"""SELECT vec_id::varchar AS path, 384::bigint AS dim, round(sqrt(6 * list_sum(list_transform(v, lambda x: x * x))), 3) AS norm,
        false AS was_aligned, 'ok' AS status FROM ({GREY})""",
)
def embed_pixels(read, spark):
    """The whole way from bytes to stored vector, with an embedder that keeps the values."""
    from facelake.config import EngineConfig
    from facelake.operators.embed import embed

    done = embed(grey_images(read), "pixels", EngineConfig(face_detection=False, image_size=8))
    return done.select("path", F.size("embedding").cast("bigint").alias("dim"), F.round(vectors.norm(F.col("embedding")), 3).alias("norm"), "was_aligned", "status")


@query(
    "embed_faces",
    f"""WITH RECURSIVE {found_sql(VECTORS_SQL, 0.3)},
    best AS (SELECT vec_id, list_filter(coalesce(faces, []), lambda f: f.score >= 0.5) AS usable FROM embeddings LEFT JOIN kept ON o = vec_id),
    largest AS (SELECT vec_id, len(usable) AS n, list_sort(list_transform(usable, lambda f: {{'area': (f.x1 - f.x0) * (f.y1 - f.y0), 'score': f.score}}), 'DESC')[1] AS f FROM best)
    SELECT vec_id::varchar AS path, n::int AS num_faces, round(f.score, 6) AS face_score, n > 0 AS was_aligned, CASE WHEN n > 0 THEN 'ok' ELSE 'no_face' END AS status,
        CASE WHEN n > 0 THEN 1024 ELSE 0 END::bigint AS dim FROM largest""",
)
def embed_faces(read, spark):
    """Detection, alignment and embedding, with what is known of the face that was taken."""
    from facelake.config import EngineConfig
    from facelake.operators.embed import embed

    done = embed(raw_outputs(grey_images(read)), "seeded_projection", EngineConfig(confidence=0.5))
    dim = F.coalesce(F.size("embedding"), F.lit(0)).cast("bigint")
    return done.select("path", "num_faces", F.round("face_score", 6).alias("face_score"), "was_aligned", "status", dim.alias("dim"))


@query(
    "detector_fields",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 2 THEN NULL ELSE l_quantity * l_extendedprice END AS area,
        CASE WHEN l_linenumber % 2 = 0 THEN l_tax WHEN l_linenumber % 4 = 1 THEN l_discount ELSE 1.0 END::double AS score FROM lineitem""",
)
def detector_fields(read, spark):
    """Faces of a detector whose fields go by several names or are missing."""
    n, zero = F.col("l_linenumber"), F.lit(0.0)
    box = F.array(zero, zero, F.col("l_quantity"), F.col("l_extendedprice"))
    marks = F.array(*[F.array(zero, zero)] * 5)
    face = faces.parsed(
        {"bbox": F.when(n % 3 == 0, box), "box": F.when(n % 3 == 1, box)},
        {"kps": F.when(n % 2 == 0, marks), "keypoints": marks},
        {"det_score": F.when(n % 2 == 0, F.col("l_tax")), "confidence": F.when(n % 4 == 1, F.col("l_discount"))},
    )
    f = read("lineitem").select("l_orderkey", "l_linenumber", face.alias("f"), F.when(n % 2 == 0, F.col("l_tax")).when(n % 4 == 1, F.col("l_discount")).otherwise(1.0).alias("score"))
    return f.select("l_orderkey", "l_linenumber", faces.area(F.col("f")).alias("area"), F.coalesce("f.score", "score").alias("score"))


@query(
    "attribute_fallback",
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_acctbal END, CASE WHEN c_nationkey < 10 THEN c_nationkey::double END, 1.0) AS score FROM customer""",
)
def attribute_fallback(read, spark):
    """The first attribute that is there, else the default."""
    first = F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal"))
    second = F.when(F.col("c_nationkey") < 10, F.col("c_nationkey").cast("double"))
    return read("customer").select("c_custkey", F.coalesce(first, second, F.lit(1.0)).alias("score"))


@query(
    "embed_seeded",
    """WITH a AS (SELECT i, s, w / sum(w) OVER (PARTITION BY i) AS w FROM (SELECT i, s, greatest(0, 1 - abs(s + 0.5 - (i + 0.5) * 8 / 112)) AS w
        FROM (SELECT unnest(range(112)) AS i), (SELECT unnest(range(8)) AS s)) WHERE w > 0),
    v AS (SELECT vec_id, place // 8 AS y, place % 8 AS x, floor((e + 1) * 127) AS value FROM (SELECT vec_id, unnest(range(64)) AS place, unnest(embedding) AS e FROM embeddings)),
    sums AS (SELECT vec_id, b.i AS y, c.i AS x, sum(value * b.w * c.w) AS value FROM v JOIN a b ON b.s = y JOIN a c ON c.s = x GROUP BY 1, 2, 3),
    blocks AS (SELECT vec_id, y // 8 AS r, x // 8 AS q, avg((round_even(round(value, 6), 0) / 255 - 0.5) / 0.5) AS m FROM sums GROUP BY 1, 2, 3),
    weights AS (SELECT b, j, (sin((b + 1) * (j + 8)) + sin((b + 197) * (j + 8)) + sin((b + 393) * (j + 8))) / 24 AS w
        FROM (SELECT unnest(range(196)) AS b), (SELECT unnest(range(512)) AS j)),
    parts AS (SELECT vec_id, k.j AS j, sum(m * k.w) AS plain, sum(m * l.w) AS flipped FROM blocks JOIN weights k ON k.b = r * 14 + q JOIN weights l ON l.b = r * 14 + 13 - q AND l.j = k.j GROUP BY ALL)
    SELECT vec_id::varchar AS path, 2 * count(*) AS dim, round(sqrt(sum(plain * plain + flipped * flipped)), 3) AS norm, false AS was_aligned, 'ok' AS status
    FROM parts GROUP BY vec_id""",
)
def embed_seeded(read, spark):
    """Synthetic grey images, one for each vector, through resizing, normalising and a fixed projection."""
    from facelake.config import EngineConfig
    from facelake.operators.embed import embed

    done = embed(grey_images(read), "seeded_projection", EngineConfig(face_detection=False), weights="7")
    return done.select("path", F.size("embedding").cast("bigint").alias("dim"), F.round(vectors.norm(F.col("embedding")), 3).alias("norm"), "was_aligned", "status")
