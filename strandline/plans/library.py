"""Queries over texts, addresses, tracks, caches, notes, sound and speech."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandline.functions import text as X, timecode as C
from strandline.operators import ranking as R, retention, speech
from strandline.operators.intervals import overlap_join
from strandline.operators.search import holding
from strandline.plans.catalogue import register
from strandline.plans.timeline import CHUNKS_SQL, CLEAN, OPENING, chunks
from strandline.sources import subtitles, views as V


@register(
    "clean_text",
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\{[^}]*\}', '', 'g'), '\\[Nnh]', ' ', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""",
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.clean_cue(F.col("text")), 256).alias("digest"))


@register("truncate_opening", f"WITH t AS (SELECT doc_id, {CLEAN.format("coalesce(text, '')")} AS x FROM documents) SELECT doc_id, {OPENING.format('x')} AS opening FROM t")
def truncate_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", X.opening(F.col("text")).alias("opening"))


@register(
    "timecode_parse",
    """WITH o AS (SELECT o_orderkey, o_orderkey * 7 % 9000 AS s FROM orders), c AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'bad' WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS code FROM o)
    SELECT o_orderkey, code, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE s::DOUBLE END AS seconds, printf('%02d:%02d:%02d,%03d', s // 3600, s // 60 % 60, s % 60, 0) AS stamp FROM c""",
)
def timecode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderkey") * 7 % 9000
    code = F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(C.show(s.cast("double")))
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", s.cast("double").alias("s"), code.alias("code"))
    return o.select("o_orderkey", "code", C.read_strict(F.col("code")).alias("seconds"), C.subtitle_time(F.col("s")).alias("stamp"))


#: addresses with parameters, upper case and other schemes, and paths
_ADDRESSES = "SELECT page_id, CASE page_id % 7 WHEN 0 THEN url || ';p=1' WHEN 1 THEN replace(url, 'http', 'HTTP') WHEN 2 THEN replace(url, 'http', 'ftp') WHEN 3 THEN '/films/' || replace(url, '/', '_') || '.v2.mkv' WHEN 4 THEN replace(url, '/en/', '/e;n/') ELSE url END AS u FROM pages"


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, k = F.col("url"), F.col("page_id") % 7
    swap = lambda a, b: F.replace(u, F.lit(a), F.lit(b))
    made = F.when(k == 0, F.concat(u, F.lit(";p=1"))).when(k == 1, swap("http", "HTTP")).when(k == 2, swap("http", "ftp")).when(k == 3, F.concat(F.lit("/films/"), swap("/", "_"), F.lit(".v2.mkv"))).when(k == 4, swap("/en/", "/e;n/")).otherwise(u)
    return V.table(spark, sf_dir, "pages").select("page_id", made.alias("u"))


_PARTS = f"a AS ({_ADDRESSES}), p AS (SELECT *, lower(string_split(u, '://')[1]) AS scheme, regexp_extract(u, '://([^/?#]*)', 1) AS host, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path FROM a), q AS (SELECT *, contains(u, '://') AND scheme IN ('http', 'https') AND host <> '' AS web, string_split(path, '/') AS parts FROM p), w AS (SELECT *, array_to_string(list_append(parts[:-2], string_split(parts[-1], ';')[1]), '/') AS plain FROM q)"


@register("public_url", f"WITH {_PARTS} SELECT page_id, CASE WHEN web THEN scheme || '://' || host || plain ELSE u END AS address, web FROM w")
def public_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses(spark, sf_dir).select("page_id", X.public_url(F.col("u")).alias("address"), X.is_web(F.col("u")).alias("web"))


_SLUG = "coalesce(nullif(lower(regexp_replace(regexp_replace({}, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g')), ''), 'film')"
_STEM = "CASE WHEN instr(substr({0}, 2), '.') > 0 AND NOT ends_with({0}, '.') THEN {0}[1:length({0}) - instr(reverse({0}), '.')] ELSE {0} END"


@register(
    "slug",
    f"""WITH {_PARTS}, n AS (SELECT *, string_split(rtrim(u, '/'), '/')[-1] AS name, CASE WHEN web THEN coalesce(nullif(string_split(rtrim(plain, '/'), '/')[-1], ''), host) END AS hint FROM w),
    t AS (SELECT *, {_STEM.format('name')} AS s, {_STEM.format('hint')} AS h FROM n), x AS (SELECT *, {_STEM.format('s')} AS ss FROM t)
    SELECT page_id, {_SLUG.format('s')} AS slug, CASE WHEN web THEN {_SLUG.format('h')} || '-' || substr(sha256(u), 1, 10) ELSE {_SLUG.format('ss')} END AS folder FROM x""",
)
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses(spark, sf_dir).select("page_id", X.slug(F.col("u")).alias("slug"), X.cache_folder(F.col("u")).alias("folder"))


@register("byte_sizes", "WITH x AS (SELECT o_orderkey, pow(o_orderkey % 150, 6)::DOUBLE AS b FROM orders) SELECT o_orderkey, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KiB', round_even(b / 1024, 1)) WHEN b < 1073741824 THEN printf('%.1f MiB', round_even(b / 1048576, 1)) WHEN b < 1099511627776 THEN printf('%.1f GiB', round_even(b / 1073741824, 1)) ELSE printf('%.1f TiB', round_even(b / 1099511627776, 1)) END AS size FROM x")
def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "orders").select("o_orderkey", X.byte_size(F.pow(F.col("o_orderkey") % 150, F.lit(6)).cast("double")).alias("size"))


@register(
    "byte_ranges",
    """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 3 AS m, o_orderkey % 700 AS a FROM orders)
    SELECT k, CASE WHEN m = 0 THEN CASE WHEN a < 500 THEN a END WHEN m = 1 THEN CASE WHEN a > 0 THEN greatest(0, 500 - a) END ELSE 0 END AS "start",
      CASE WHEN m = 0 THEN CASE WHEN a < 500 THEN least(499, a + 9) END WHEN m = 1 THEN CASE WHEN a > 0 THEN 499 END ELSE 499 END AS "end",
      CASE WHEN m = 0 AND a >= 500 OR m = 1 AND a = 0 THEN 416 WHEN m = 2 THEN 200 ELSE 206 END AS status FROM x""",
)
def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    header = F.when(k % 3 == 0, F.format_string("bytes=%d-%d", k % 700, k % 700 + 9)).when(k % 3 == 1, F.format_string("bytes=-%d", k % 700))
    return V.table(spark, sf_dir, "orders").select(k.alias("k"), header.alias("h")).select("k", X.byte_range(F.col("h"), F.lit(500).cast("long")).alias("r")).select("k", "r.*")


_RANK = "CASE lang WHEN 'es' THEN 0 WHEN 'de' THEN 1 WHEN 'en' THEN 2 ELSE 103 END"


@register(
    "track_choice",
    f"WITH t AS (SELECT source, lang, min(n_chars) % 2 = 1 AS automatic FROM documents GROUP BY source, lang) SELECT source, lang, automatic FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY automatic, {_RANK}, length(lang), lang) AS p FROM t) WHERE p = 1",
)
def track_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.table(spark, sf_dir, "documents").groupBy("source", "lang").agg((F.min("n_chars") % 2 == 1).alias("automatic"))
    return R.remote_track(t, ["source"], ("es", "de", "en"))


_EMBED = "SELECT o_custkey % 200 AS film, o_orderkey AS \"index\", CASE o_orderkey % 4 WHEN 0 THEN 'subrip' WHEN 1 THEN 'ass' WHEN 2 THEN 'hdmv_pgs_subtitle' ELSE 'mov_text' END AS codec, CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS lang, o_orderstatus = 'P' AS commentary, o_orderpriority = '1-URGENT' AS is_default, o_orderstatus = 'F' AS forced FROM orders"


@register(
    "embedded_choice",
    f"WITH s AS ({_EMBED}) SELECT film, \"index\", codec, lang FROM (SELECT *, row_number() OVER (PARTITION BY film ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 102 END, commentary, NOT is_default, forced, \"index\") AS p FROM s WHERE codec <> 'hdmv_pgs_subtitle') WHERE p = 1",
)
def embedded_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    codec = F.when(k % 4 == 0, "subrip").when(k % 4 == 1, "ass").when(k % 4 == 2, "hdmv_pgs_subtitle").otherwise("mov_text")
    lang = F.when(k % 3 == 0, "en").when(k % 3 == 1, "de").otherwise("fr")
    s = V.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("film"), k.alias("index"), codec.alias("codec"), lang.alias("lang"), (F.col("o_orderstatus") == "P").alias("commentary"), (F.col("o_orderpriority") == "1-URGENT").alias("is_default"), (F.col("o_orderstatus") == "F").alias("forced"))
    return R.embedded_track(s, ["film"], ("de", "en"))


_FILES = "SELECT doc_id // 10 AS film, doc_id % 10 = 3 AND n_chars % 2 = 0 AS stem_match, doc_id // 10 % 2 = 0 AS only_one, lang, CASE WHEN n_chars % 3 = 0 THEN '.ass' ELSE '.srt' END AS ext, source || '-' || doc_id AS name FROM documents"


@register("sidecar_choice", f"WITH f AS ({_FILES}) SELECT film, name FROM (SELECT *, row_number() OVER (PARTITION BY film ORDER BY NOT stem_match, {_RANK}, ext, name) AS p FROM f WHERE stem_match OR only_one) WHERE p = 1")
def sidecar_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    film = F.floor(F.col("doc_id") / 10)
    ext = F.when(F.col("n_chars") % 3 == 0, ".ass").otherwise(".srt")
    f = d.select(film.alias("film"), ((F.col("doc_id") % 10 == 3) & (F.col("n_chars") % 2 == 0)).alias("stem_match"), (film % 2 == 0).alias("only_one"), "lang", ext.alias("ext"), F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("name"))
    return R.sidecar_file(f, ["film"], ("es", "de", "en"))


_CACHE_SQL = "v_cache AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'local' ELSE 'url' END AS kind, o_orderstatus = 'P' AS running, o_orderdate AS last_access, CAST(o_totalprice AS BIGINT) AS bytes, TIMESTAMP '1998-08-02 00:00:00' AS now FROM orders), v_state AS (SELECT *, epoch_us(now) - epoch_us(last_access) >= 86400000000 * 30 AND kind = 'url' AND NOT running AS goes FROM v_cache)"


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("timestamp")
    e = V.table(spark, sf_dir, "orders").select(k.alias("key"), F.when(k % 3 == 0, "local").otherwise("url").alias("kind"), (F.col("o_orderstatus") == "P").alias("running"), F.col("o_orderdate").cast("timestamp").alias("last_access"), none.alias("prepared"), none.alias("modified"), F.bround("o_totalprice", 0).cast("long").alias("bytes"))
    return retention.status(e, F.lit("1998-08-02 00:00:00").cast("timestamp"), 30 * 86400.0)


@register("cache_ttl", f"WITH {_CACHE_SQL} SELECT key, kind, goes FROM v_state")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_entries(spark, sf_dir).select("key", "kind", "goes")


@register("cache_summary", f"WITH {_CACHE_SQL} SELECT count(*) AS entries, CAST(sum(round_even(o_totalprice, 0)) AS BIGINT) AS bytes, count(*) FILTER (goes) AS gone, CAST(sum(round_even(o_totalprice, 0)) FILTER (goes) AS BIGINT) AS gone_bytes FROM v_state JOIN orders ON o_orderkey = key")
def cache_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.summary(cache_entries(spark, sf_dir))


@register("registry_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) WHERE p = 1")
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(V.table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


PCM_SQL = V.SAMPLES_SQL + ", v_bins AS (SELECT film_id, (n - 1) // 4 AS bin, sqrt(sqrt(avg(pow(round_even((luma - 0.5::DOUBLE) * 20000, 0), 2))) / 32768) * 2.2::DOUBLE AS e FROM v_samples GROUP BY film_id, (n - 1) // 4)"


def sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.samples(spark, sf_dir)
    return speech.audio_bins(s.select("film_id", (F.col("n") - 1).alias("i"), F.bround((F.col("luma") - 0.5) * 20000, 0).alias("x")), 4, 0.25)


@register("audio_bins", f"WITH {PCM_SQL} SELECT film_id, bin, round_even(bin * 0.25::DOUBLE, 3) AS t, round_even(least(1.0::DOUBLE, e), 4) AS level, round_even(e, 4) AS energy FROM v_bins")
def audio_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sound(spark, sf_dir)


@register(
    "audio_transient",
    f"""WITH {PCM_SQL}, b AS (SELECT film_id, bin, round_even(e, 4) AS e FROM v_bins),
    w AS (SELECT film_id, bin, max(e) OVER (PARTITION BY film_id ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, list_sort(list(e) OVER (PARTITION BY film_id ORDER BY bin RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING)) AS x FROM b),
    m AS (SELECT *, x[CAST(floor((len(x) - 1) * 0.5::DOUBLE) AS BIGINT) + 1] AS mid, x[CAST(floor((len(x) - 1) * 0.9::DOUBLE) AS BIGINT) + 1] AS high FROM w)
    SELECT film_id, bin, CASE WHEN near >= 0.12::DOUBLE THEN round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (near - mid) / greatest(0.08::DOUBLE, high - mid))), 6) ELSE 0.0::DOUBLE END AS event FROM m""",
)
def audio_transient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.transients(sound(spark, sf_dir)).select("film_id", "bin", "event")


@register(
    "asr_filter",
    """WITH a AS (SELECT o_orderkey AS k, o_orderkey % 11 AS m, CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE ' ' || o_orderpriority || ' ' END AS x FROM orders)
    SELECT k, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS text FROM a WHERE k % 7 <> 0 AND NOT (m = 1) AND NOT (m = 2 AND k % 2 = 0) AND m <> 3""",
)
def asr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 11
    text = F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")))
    rows = V.table(spark, sf_dir, "orders").select(
        k.alias("k"), text.alias("text"), F.lit(0.0).alias("start"), F.when(m == 3, 0.0).otherwise(1.0).alias("end"),
        F.when(m == 1, "0.9").otherwise("0.1").alias("no_speech"), F.when(m == 1, "-1.5").when((m == 2) & (k % 2 == 1), "n/a").otherwise("-0.2").alias("logprob"), F.when(m == 2, "3.5").otherwise("1.2").alias("compression"),
    )
    return speech.usable_segments(rows).select("k", "text")


@register(
    "asr_ownership",
    f"""WITH {V.CUES_SQL}, {CHUNKS_SQL}, x AS (SELECT c.film_id, idx, ord, (start + "end") / 2 AS mid, "from", "to", idx = min(idx) OVER (PARTITION BY c.film_id) AS f, idx = max(idx) OVER (PARTITION BY c.film_id) AS l, q.start, q."end" FROM v_chunks c JOIN v_cues q USING (film_id))
    SELECT film_id, idx, ord FROM x WHERE "end" >= "from" AND start <= "to" AND (mid >= "from" OR f) AND (mid < "to" OR l)""",
)
def asr_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.cues(spark, sf_dir)
    w = Window.partitionBy("film_id")
    c = chunks(q).withColumn("first_window", F.col("idx") == F.min("idx").over(w)).withColumn("last_window", F.col("idx") == F.max("idx").over(w))
    return speech.owned(overlap_join(c, q, ["film_id"], ("from", "to"), ("start", "end"), 10.0), ["film_id"]).select("film_id", "idx", "ord")


@register("notes_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(role), CASE WHEN turn % 4 <> 0 THEN turn * 3.5::DOUBLE END NULLS LAST, turn) AS place FROM conversations")
def notes_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("film_id"), "turn", F.length("role").alias("chunk"), F.when(F.col("turn") % 4 != 0, F.col("turn") * F.lit(3.5)).alias("time"), F.col("turn").alias("created_at"))
    return R.notes_in_order(n).select(F.col("film_id").alias("conv_id"), "turn", "place")


@register("notes_per_chunk", "SELECT conv_id, coalesce(CASE WHEN turn % 5 = 4 THEN NULL ELSE turn // 3 END, -1) AS chunk, count(*) AS notes FROM conversations GROUP BY 1, 2")
def notes_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.coalesce(F.when(F.col("turn") % 5 != 4, F.floor(F.col("turn") / 3)), F.lit(-1)).cast("long")
    return V.table(spark, sf_dir, "conversations").groupBy("conv_id", chunk.alias("chunk")).agg(F.count("*").alias("notes"))


@register(
    "row_pack",
    f"""WITH {V.CUES_SQL}, c AS (SELECT film_id, count(*) AS n FROM v_cues GROUP BY film_id), k AS (SELECT film_id, n, unnest([3, 4, 5, 6]) AS k FROM c), p AS (SELECT film_id, CAST(ceil(n / k::DOUBLE) AS BIGINT) AS rows, CAST(ceil(n / k::DOUBLE) * k - n AS BIGINT) AS empty, k::BIGINT AS per_row FROM k)
    SELECT film_id, rows, empty, per_row FROM (SELECT *, row_number() OVER (PARTITION BY film_id ORDER BY rows, empty, per_row) AS r FROM p) WHERE r = 1""",
)
def row_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.cues(spark, sf_dir).groupBy("film_id").agg(F.count("*").alias("n"))
    return n.select("film_id", R.row_pack(F.col("n"), 3, 6).alias("p")).select("film_id", "p.*")


def located(texts: DataFrame, wanted: DataFrame, grams: int = 3) -> DataFrame:
    """Pairs of a text (doc_id, text) and a wanted phrase (item_id, phrase) it holds, case and runs of white space apart; empty phrases are held by none.

    A phrase that stands in a text stands there with all its inner words, so phrases
    of grams + 2 words or more meet texts on their second to fourth word. What meets
    on a key is a pair of hashes; texts and phrases are joined to the distinct pairs,
    and looked at, once each. Shorter phrases, which may lie within words, are looked
    for in every text, in blocks.
    """
    form = lambda c: X.squeeze(F.lower(c))
    t = texts.select("doc_id", form("text").alias("t")).filter("t <> ''").withColumn("tk", F.xxhash64("doc_id", "t"))
    w = wanted.select("item_id", form("phrase").alias("p")).filter("p <> ''").withColumn("pk", F.xxhash64("item_id", "p"))
    words = F.split("t", " ")
    long = F.size(F.split("p", " ")) >= grams + 2
    runs = lambda n, last, key: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last - n + 1, F.lit(1))), key))
    by_word = F.transform(F.array(words), lambda ws: runs(grams, F.size(ws), lambda i: F.xxhash64(F.array_join(F.slice(ws, i, grams), " "))))[0]
    keys = w.filter(long).select("pk", F.xxhash64(F.array_join(F.slice(F.split("p", " "), 2, grams), " ")).alias("key"))
    met = t.select("tk", F.explode(by_word).alias("key")).join(keys, "key").select("tk", "pk")
    pairs = met.distinct().join(t, "tk").join(w, "pk").filter(F.col("t").contains(F.col("p"))).select("doc_id", "item_id")
    short = holding(t, w.filter(~long)).join(t.select("tk", "doc_id"), "tk").join(w.select("pk", "item_id"), "pk").select("doc_id", "item_id")
    return pairs.unionByName(short).distinct()


_FORM = r"regexp_replace(regexp_replace(lower({}), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@register("locate_text", f"WITH n AS (SELECT doc_id, {_FORM.format('text')} AS t FROM documents), b AS (SELECT item_id, {_FORM.format('text')} AS p FROM benchmark) SELECT DISTINCT doc_id, item_id FROM n JOIN b ON contains(t, p) WHERE p <> ''")
def locate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark item."""
    return located(V.table(spark, sf_dir, "documents"), V.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase")))


@register(
    "locate_phrase",
    f"WITH n AS (SELECT doc_id, {_FORM.format('text')} AS t FROM documents), b AS (SELECT p_partkey AS item_id, {_FORM.format('p_name')} AS p FROM part WHERE p_partkey <= 40 UNION ALL SELECT item_id + 1000, string_split({_FORM.format('text')}, ' ')[2] FROM benchmark) SELECT DISTINCT doc_id, item_id FROM n JOIN b ON contains(t, p) WHERE p <> ''",
)
def locate_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold one of some short phrases: one word of each benchmark item, and names of parts."""
    word = V.table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("item_id"), F.get(F.split(X.squeeze(F.lower("text")), " "), F.lit(1)).alias("phrase"))
    part = V.table(spark, sf_dir, "part").filter("p_partkey <= 40").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("phrase"))
    return located(V.table(spark, sf_dir, "documents"), part.unionByName(word))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of made-up boxes from the customers, ten a frame."""
    c = V.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    box = F.struct(F.concat(F.col("c_mktsegment"), F.lit(" "), (k % 7).cast("string")).alias("text"), ((k % 10) / 10).alias("confidence"), ((k % 9) / 10).alias("x"), ((k % 13) / 13).alias("y"), ((k % 5) / 20).alias("width"))
    return c.groupBy(F.floor(k / 10).alias("frame")).agg(F.array_sort(F.collect_list(box)).alias("boxes"))


@register(
    "ocr_row_filter",
    """WITH b AS (SELECT c_custkey // 10 AS frame, c_mktsegment || ' ' || c_custkey % 7 AS x, (c_custkey % 10) / 10::DOUBLE AS c, (c_custkey % 9) / 10::DOUBLE AS a, (c_custkey % 13) / 13::DOUBLE AS y, (c_custkey % 5) / 20::DOUBLE AS w FROM customer),
    g AS (SELECT * FROM b WHERE c >= 0.25::DOUBLE AND w >= 0.035::DOUBLE AND a + w / 2 BETWEEN 0.12::DOUBLE AND 0.88::DOUBLE),
    o AS (SELECT *, row_number() OVER (PARTITION BY frame, x ORDER BY -y, c) AS p FROM g)
    SELECT frame, string_agg(x, ' / ' ORDER BY -y, x, c) AS text, round_even(avg(c), 6) AS confidence FROM o WHERE p = 1 GROUP BY frame""",
)
def ocr_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = speech.readings(boxes(spark, sf_dir)).select("frame", F.col("reading").alias("r")).filter("r is not null")
    return r.select("frame", "r.text", F.bround("r.confidence", 6).alias("confidence"))


_READ = "SELECT film_id, ord, start, regexp_matches(text, '[\\p{L}\\p{N}]') AS named, text FROM v_cues"


@register(
    "ocr_merge",
    f"""WITH {V.CUES_SQL}, t AS ({_READ})
    SELECT film_id, start, start + 1.5 AS "end", text || '?' AS text, round_even((0.6::DOUBLE + 0.9::DOUBLE + 0.7::DOUBLE) / 3, 6) AS confidence, 3::BIGINT AS observations FROM t WHERE named
    UNION ALL SELECT film_id, start + 0.5 * i, start + 0.5 * i + 0.5, text || ['', '?', '!'][i + 1], [0.6::DOUBLE, 0.9::DOUBLE, 0.7::DOUBLE][i + 1], 1 FROM (SELECT *, unnest(range(0, 3)) AS i FROM t) WHERE NOT named""",
)
def ocr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues from three readings of each of a conversation's turns, which differ in a sign and in confidence."""
    q = V.cues(spark, sf_dir)
    read = F.array(*(F.struct((F.col("start") + 0.5 * i).alias("time"), F.concat("text", F.lit(sign)).alias("text"), F.lit(sure).alias("confidence")) for i, (sign, sure) in enumerate((("", 0.6), ("?", 0.9), ("!", 0.7)))))
    merged = speech.merge_readings(q.select("film_id", F.explode(read).alias("r")).select("film_id", "r.*"), 0.5)
    return merged.withColumn("confidence", F.bround("confidence", 6))


@register("text_similarity")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each cue is to the cue before, whole texts."""
    q = V.cues(spark, sf_dir).select("film_id", "ord", F.col("text").alias("x"))
    before = F.lag("x").over(Window.partitionBy("film_id").orderBy("ord"))
    return q.withColumn("y", before).filter("y is not null").select("film_id", "ord", F.bround(speech.text_similarity("x", "y"), 6).alias("alike"), speech.normalized("x").alias("plain"))


@register(
    "detection_times",
    f"""WITH {V.CUES_SQL}, d AS (SELECT film_id, max("end") * 10 AS d FROM v_cues GROUP BY film_id), m AS (SELECT *, least(30.0::DOUBLE, d * 0.03::DOUBLE) AS g FROM d),
    x AS (SELECT film_id, d, round_even(g + greatest(0.0::DOUBLE, d - g * 2) * (i + 0.5::DOUBLE) / 20, 3) AS t FROM (SELECT *, unnest(range(0, 20)) AS i FROM m) UNION SELECT film_id, d, k::DOUBLE FROM (SELECT *, unnest([60, 120, 180, 300, 450, 600]) AS k FROM m))
    SELECT film_id, count(*) AS times, round_even(max(t), 3) AS last FROM x WHERE t >= 0 AND t < d GROUP BY film_id""",
)
def detection_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.cues(spark, sf_dir).groupBy("film_id").agg((F.max("end") * 10).alias("d"))
    t = d.select("film_id", speech.detection_times(F.col("d")).alias("t"))
    return t.select("film_id", F.size("t").cast("long").alias("times"), F.bround(F.array_max("t"), 3).alias("last"))


@register(
    "subtitle_files",
    f"""WITH {V.CUES_SQL}, b AS (SELECT film_id, ord, (ord + 1) || chr(10) || printf('%02d:%02d:%02d,%03d', CAST(round_even(start * 1000, 0) AS BIGINT) // 3600000, CAST(round_even(start * 1000, 0) AS BIGINT) // 60000 % 60, CAST(round_even(start * 1000, 0) AS BIGINT) // 1000 % 60, CAST(round_even(start * 1000, 0) AS BIGINT) % 1000)
      || ' --> ' || printf('%02d:%02d:%02d,%03d', CAST(round_even("end" * 1000, 0) AS BIGINT) // 3600000, CAST(round_even("end" * 1000, 0) AS BIGINT) // 60000 % 60, CAST(round_even("end" * 1000, 0) AS BIGINT) // 1000 % 60, CAST(round_even("end" * 1000, 0) AS BIGINT) % 1000) || chr(10) || CASE WHEN film_id % 2 = 0 THEN replace(text, ' / ', chr(10)) ELSE text END || chr(10) AS x FROM v_cues)
    SELECT film_id, sha256(string_agg(x, chr(10) ORDER BY ord)) AS digest FROM b GROUP BY film_id""",
)
def subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SRT file of each film; in every other one, joined texts get a line for each part."""
    q = V.cues(spark, sf_dir).select("film_id", (F.col("ord") + 1).alias("ord"), "start", "end", "text")
    made = [subtitles.srt_text(q.filter(F.col("film_id") % 2 == k), ["film_id"], joined=k == 0) for k in (0, 1)]
    return made[0].unionByName(made[1]).select("film_id", F.sha2("srt", 256).alias("digest"))
