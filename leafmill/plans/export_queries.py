"""Exports for training, block decoding, dictionary lookups and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import decode as D
from ..operators import models
from . import views as V
from .text_queries import _LEXICON, lexicon

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""with {V.WORDS}, p as (select doc_id, (max(l + w) + 40)::int pw, (max(t + h) + 60)::int ph from words group by doc_id),
s as (select *, trunc(pw / 2)::int tw, trunc(ph / 2)::int th, trunc(trunc(pw / 2) * 0.125)::int mx, trunc(trunc(ph / 2) * 0.125)::int my from p),
g as (select doc_id, x, y, greatest(0, x * tw - mx) tl, greatest(0, y * th - my) tt, least(pw, (x + 1) * tw + mx) tr, least(ph, (y + 1) * th + my) tb from s, range(2) a(x), range(2) b(y))
select doc_id, x, y, count(*) n, sum({V.millionths_sql('2 * (l - tl) + w', '2 * (tr - tl)')})::bigint xc, sum({V.millionths_sql('w', 'tr - tl')})::bigint bw from words join g using (doc_id) where l >= tl and t >= tt and l + w <= tr and t + h <= tb group by all""")
def tile_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes that lie whole in a tile, in millionths of it."""
    w = V.words(spark, sf)
    r = G.rect()
    pages = w.groupBy("doc_id").agg((F.max(r.r) + 40).cast("int").alias("pw"), (F.max(r.b) + 60).cast("int").alias("ph"))
    tiles = pages.select("doc_id", F.explode(G.tiles(F.col("pw"), F.col("ph"), 2, 2, 0.125)).alias("q")).select("doc_id", "q.x", "q.y", *[F.col(f"q.{c}").alias(f"q_{c}") for c in "ltwh"])
    met = w.join(tiles, "doc_id").filter(G.contains(G.rect("q_"), r))
    return met.groupBy("doc_id", "x", "y").agg(F.count("*").alias("n"), F.sum(T.millionths(2 * (r.l - F.col("q_l")) + r.w, 2 * F.col("q_w"))).alias("xc"), F.sum(T.millionths(r.w, F.col("q_w"))).alias("bw"))


@query(f"""with {V.WORDS}, g as (select *, unnest(range(length(content)))::int i from words), k as (select doc_id, line_idx, tok_idx, i glyph_idx, substring(content, i + 1, 1) glyph, l + 10 * i gl, t, trunc(1.1 * h)::int edge from g)
select doc_id, line_idx, tok_idx, glyph_idx, glyph, greatest(0, gl - (greatest(10, edge) - 10) // 2) l, greatest(0, t - (edge - 16) // 2) t, greatest(10, edge) w, edge h from k""")
def glyph_crops(spark: SparkSession, sf: str) -> DataFrame:
    """Crops a tenth higher than their glyph and at least as wide as high, on the page."""
    g = V.words(spark, sf).select("doc_id", "line_idx", "tok_idx", "content", "l", "t", "h", F.explode(F.sequence(F.lit(0), F.length("content") - 1)).alias("glyph_idx"))
    edge = (F.lit(1.1) * F.col("h")).cast("int")
    left = F.col("l") + F.col("glyph_idx") * 10 - F.floor((F.greatest(F.lit(10), edge) - 10) / 2)
    return g.select("doc_id", "line_idx", "tok_idx", "glyph_idx", F.expr("substring(content, glyph_idx + 1, 1)").alias("glyph"), F.greatest(F.lit(0), left).cast("int").alias("l"), F.greatest(F.lit(0), F.col("t") - F.floor((edge - F.col("h")) / 2)).cast("int").alias("t"), F.greatest(F.lit(10), edge).alias("w"), edge.alias("h"))


@query("""select doc_id, source || '/' || doc_id || '.png' file, printf('%.2f', (doc_id % 41 - 20) / 10.0) rotation from documents""")
def rotation_labels(spark: SparkSession, sf: str) -> DataFrame:
    angle = (F.col("doc_id") % 41 - 20) / F.lit(10.0)
    return V.table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("file"), F.format_string("%.2f", angle).alias("rotation"))


@query(f"""with {V.WORDS}, {_LEXICON}, n as (select doc_id, line_idx, lower(arg_max(content, tok_idx)) last_word, lower(arg_min(content, tok_idx)) first_word, count(*) n from words group by all),
p as (select *, lag(last_word) over o before, lead(first_word) over o after from n window o as (partition by doc_id order by line_idx)),
j as (select p.*, exists (select 1 from lexicon where word = last_word || after) takes, exists (select 1 from lexicon where word = before || first_word) taken from p)
select doc_id, line_idx, case when takes then last_word || after else last_word end line_end, taken first_is_carried, n - taken::int n_words from j""")
def block_decode(spark: SparkSession, sf: str) -> DataFrame:
    """A line's last word takes the next line's first where the lexicon knows them as one; that word is then gone from its line."""
    n = V.words(spark, sf).groupBy("doc_id", "line_idx").agg(F.lower(F.max_by("content", "tok_idx")).alias("last_word"), F.lower(F.min_by("content", "tok_idx")).alias("first_word"), F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("line_idx")
    p = n.withColumn("_after", F.concat("last_word", F.lead("first_word").over(w))).withColumn("_before", F.concat(F.lag("last_word").over(w), "first_word"))
    p = D.with_known(D.with_known(p, lexicon(spark, sf), "_after", "takes"), lexicon(spark, sf), "_before", "taken")
    return p.select("doc_id", "line_idx", F.when(F.col("takes"), F.col("_after")).otherwise(F.col("last_word")).alias("line_end"), F.col("taken").alias("first_is_carried"), (F.col("n") - F.col("taken").cast("int")).alias("n_words"))


@query(f"""with {V.WORDS}, {_LEXICON}, d as (select word, reverse(word) spoken, length(word) % 3 = 0 homograph from lexicon), c as (select doc_id, line_idx, tok_idx, lower(content) word from words)
select doc_id, line_idx, tok_idx, case when d.word is null or d.homograph then c.word else d.spoken end spoken from c left join d on c.word = d.word""")
def dictionary_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Pronunciations from a dictionary; homographs are left as they are."""
    d = lexicon(spark, sf).select(F.col("word").alias("_w"), F.reverse("word").alias("_spoken"), (F.length("word") % 3 == 0).alias("_homograph"))
    c = V.words(spark, sf).select("doc_id", "line_idx", "tok_idx", F.lower("content").alias("word")).join(d, F.col("word") == F.col("_w"), "left")
    return c.select("doc_id", "line_idx", "tok_idx", F.when(F.col("_w").isNull() | F.col("_homograph"), F.col("word")).otherwise(F.col("_spoken")).alias("spoken"))


@query(f"""with {V.WORDS}, {_LEXICON}, w as (select distinct lower(content) word from words), x as (select word, 'new' kind from w except select word, 'new' from lexicon), y as (select word, 'both' kind from w intersect select word, 'both' from lexicon)
select kind, count(*) n, min(word) first_word from (select * from x union all select * from y) group by kind""")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the corpus that the lexicon lacks, and those that it has."""
    w, known = V.words(spark, sf).select(F.lower("content").alias("word")).distinct(), lexicon(spark, sf)
    new, both = w.subtract(known).withColumn("kind", F.lit("new")), w.intersect(known).withColumn("kind", F.lit("both"))
    return new.unionByName(both).groupBy("kind").agg(F.count("*").alias("n"), F.min("word").alias("first_word"))


@query("""with c as (select distinct lower(c) glyph from (select unnest(string_split(text, '')) c from benchmark) where regexp_matches(c, '\\S')), k as (select glyph, row_number() over (order by glyph) - 1 i from c),
d as (select doc_id, lower(unnest(string_split(text, ''))) glyph from documents) select doc_id, count(*) n, count(*) filter (i is null) n_unknown, sum(coalesce(i, (select count(*) from c)))::bigint class_sum from d left join k using (glyph) where regexp_matches(glyph, '\\S') group by doc_id""")
def class_indices(spark: SparkSession, sf: str) -> DataFrame:
    """Glyphs as class numbers of an alphabet; unknown ones get the number after the last."""
    c = V.table(spark, sf, "benchmark").select(F.explode(T.characters(F.lower("text"))).alias("glyph")).filter(r"glyph rlike '\\S'")
    classes = models.class_index(c)
    d = V.dealt(V.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.explode(T.characters(F.lower("text"))).alias("glyph")).filter(r"glyph rlike '\\S'")
    # counts first: the join then sees a document's distinct glyphs
    d = d.groupBy("doc_id", "glyph").agg(F.count("*").alias("m"))
    size = classes.agg(F.count("*").cast("int")).scalar()
    return models.with_class(d, classes).groupBy("doc_id").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("class_idx") == size, F.col("m")).otherwise(0)).alias("n_unknown"), F.sum(F.col("class_idx") * F.col("m")).alias("class_sum"))


@query()
def perceptron_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of a perceptron on held-out vectors."""
    rows = V.table(spark, sf, "embeddings").select("embedding", "label")
    classes = rows.agg(F.max("label")).first()[0] + 1
    _, hits = models.train_perceptron(rows, "embedding", "label", classes, (32,), 30)
    return spark.createDataFrame([("perceptron", float(hits or 0.0))], "model string, accuracy double")
