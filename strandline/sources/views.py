"""Timelines from the supplied tables, which stand in for film data.

One hour of an event stream plays the role of one second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: The hour since the epoch at which the event tables begin.
FIRST_HOUR = 473352


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """film_id, n from 1, t, luma, saturation, contrast, edge: a user's events in order."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("film_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", "props")
    k = F.get_json_object("props", "$.k").cast("double")
    n = F.row_number().over(Window.partitionBy("film_id").orderBy("us", "event_id"))
    return e.select("film_id", "event_id", n.cast("long").alias("n"), (F.col("us") / 3.6e9 - FIRST_HOUR).alias("t"), (F.col("value") / 500).alias("luma"), (k / 100).alias("saturation"), (k / 400).alias("contrast"), ((F.col("event_id") % 100) / 500).alias("edge"))


SAMPLES_SQL = f"""
v_samples AS (SELECT user_id AS film_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n, epoch_us(ts) / 3.6e9::DOUBLE - {FIRST_HOUR} AS t,
    value / 500::DOUBLE AS luma, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS saturation, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 400 AS contrast, (event_id % 100) / 500::DOUBLE AS edge FROM events)
"""


_TILES = 4


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples() with r, g, b, motion, and four tiles (r, g, b, luma), made from the same events."""
    e = F.col("event_id")
    whole = lambda x: F.bround(x, 0)
    s = samples(spark, sf_dir).withColumn("r", whole(F.least(F.col("luma"), F.lit(1.0)) * 255)).withColumn("g", whole(F.col("saturation") * 255)).withColumn("b", (e * 37 % 256).cast("double"))
    tile = lambda i: F.struct(((F.col("r") + i * (e % 17)) % 256).alias("r"), F.col("g").alias("g"), ((F.col("b") + i * 31) % 256).alias("b"), (F.col("luma") * (_TILES - i) / _TILES).alias("luma"))
    return s.withColumn("motion", (e * 13 % 50) / 500).withColumn("tiles", F.array(*map(tile, range(_TILES))))


_PREV = {i: (f"((r + {i} * (event_id % 17)) % 256)", f"((b + {i} * 31) % 256)", f"luma * {_TILES - i} / {_TILES}") for i in range(_TILES)}
_WAS = {i: (f"((lag(r) OVER w + {i} * (lag(event_id) OVER w % 17)) % 256)", f"((lag(b) OVER w + {i} * 31) % 256)", f"lag(luma) OVER w * {_TILES - i} / {_TILES}") for i in range(_TILES)}
_STEP = [f"sqrt(pow({_PREV[i][0]} - {_WAS[i][0]}, 2) + pow(g - lag(g) OVER w, 2) + pow({_PREV[i][1]} - {_WAS[i][1]}, 2))" for i in range(_TILES)]
_LIGHT = [f"abs({_PREV[i][2]} - {_WAS[i][2]})" for i in range(_TILES)]
#: v_frames has regional, delta and change beside the columns of frames() but its tiles
FRAMES_SQL = (
    SAMPLES_SQL
    + f""",
v_frame AS (SELECT *, round_even(least(luma, 1.0::DOUBLE) * 255, 0) AS r, round_even(saturation * 255, 0) AS g, (event_id * 37 % 256)::DOUBLE AS b, (event_id * 13 % 50) / 500::DOUBLE AS motion FROM v_samples),
v_regional AS (SELECT *, coalesce(greatest({", ".join(_STEP)}) * 0.7::DOUBLE + ({" + ".join(_STEP)}) / {_TILES} * 0.25::DOUBLE + greatest({", ".join(_LIGHT)}) * 120, 0) AS regional,
    coalesce(sqrt(pow(r - lag(r) OVER w, 2) + pow(g - lag(g) OVER w, 2) + pow(b - lag(b) OVER w, 2)), 0) AS delta FROM v_frame WINDOW w AS (PARTITION BY film_id ORDER BY n)),
v_frames AS (SELECT *, coalesce(delta + abs(luma - lag(luma) OVER w) * 220 + abs(contrast - lag(contrast) OVER w) * 90 + abs(edge - lag(edge) OVER w) * 90 + motion * 260 + regional * 0.8::DOUBLE, 0) AS change
    FROM v_regional WINDOW w AS (PARTITION BY film_id ORDER BY n))
"""
)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """film_id, n, t and frame: pictures of 4 by 4 pixels (rgb24), from vectors of 64 values."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("film_id"), "vec_id", F.slice("embedding", 1, 48).alias("e"))
    n = F.row_number().over(Window.partitionBy("film_id").orderBy("vec_id")).cast("long")
    byte = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5)))), 2, "0")
    return e.select("film_id", n.alias("n"), F.unhex(F.array_join(F.transform("e", byte), "")).alias("frame")).withColumn("t", (F.col("n") - 1).cast("double"))


PIXELS_SQL = """
v_byte AS (SELECT label::BIGINT AS film_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, embedding AS e FROM embeddings),
v_pixel AS (SELECT film_id, n, i, i % 4 AS x, i // 4 AS y, greatest(0, least(255, CAST(floor((e[3 * i + 1]::DOUBLE + 1) * 127.5::DOUBLE) AS BIGINT))) AS r, greatest(0, least(255, CAST(floor((e[3 * i + 2]::DOUBLE + 1) * 127.5::DOUBLE) AS BIGINT))) AS g,
    greatest(0, least(255, CAST(floor((e[3 * i + 3]::DOUBLE + 1) * 127.5::DOUBLE) AS BIGINT))) AS b FROM (SELECT *, unnest(range(0, 16)) AS i FROM v_byte)),
v_luma AS (SELECT *, (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) / 255 AS l FROM v_pixel)
"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """film_id, ord, start, end, style, text: a conversation's turns."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * F.lit(4.0)
    return c.select(F.col("conv_id").alias("film_id"), F.col("turn").alias("ord"), start.alias("start"), (start + F.least(F.lit(8.0), 1 + F.length("text") / 40)).alias("end"), F.col("role").alias("style"), "text")


CUES_SQL = """
v_cues AS (SELECT conv_id AS film_id, turn AS ord, turn * 4.0::DOUBLE AS start, turn * 4.0::DOUBLE + least(8.0::DOUBLE, 1 + length(text) / 40::DOUBLE) AS "end", role AS style, text FROM conversations)
"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """film_id, n, tiles (array of r, g, b, luma) and the mean colour of each vector of 64 values."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("film_id"), "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = F.row_number().over(Window.partitionBy("film_id").orderBy("vec_id")).cast("long")
    c = lambda i, k: F.bround((F.col("e")[i * 4 + k] + 1) * 127.5, 0)
    made = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(c(i, 0).alias("r"), c(i, 1).alias("g"), c(i, 2).alias("b"), ((F.col("e")[i * 4 + 3] + 1) / 2).alias("luma")))
    mean = lambda k: F.bround(F.aggregate("tiles", F.lit(0.0), lambda a, x: a + x[k]) / 16, 0)
    return e.select("film_id", "vec_id", n.alias("n"), made.alias("tiles")).select("*", *(mean(k).alias(k) for k in "rgb"))


_TILE = "round_even((e[i * 4 + {}]::DOUBLE + 1) * 127.5, 0)"
TILES_SQL = f"""
v_tile AS (SELECT film_id, vec_id, n, i, {_TILE.format(1)} AS r, {_TILE.format(2)} AS g, {_TILE.format(3)} AS b, (e[i * 4 + 4]::DOUBLE + 1) / 2 AS luma
    FROM (SELECT label::BIGINT AS film_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, embedding AS e, unnest(range(0, 16)) AS i FROM embeddings)),
v_mean AS (SELECT film_id, vec_id, n, round_even(sum(r) / 16, 0) AS r, round_even(sum(g) / 16, 0) AS g, round_even(sum(b) / 16, 0) AS b FROM v_tile GROUP BY film_id, vec_id, n)
"""
