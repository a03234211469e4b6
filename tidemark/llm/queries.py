"""The training-data operators as registered queries, with their production parameters, and SQL for them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import clustering, langid, minhash, mixing, mpeg_audio, packing, pseudo_likelihood, sharding, signature_join, simhash, spelling, url_filter, warc

# Fixed values of the URL query: rules and their verdicts.
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

# Fixed values of the clustering query.
CLUSTERS, CLUSTER_ROUNDS, DIM = 40, 5, 64

VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.fit_and_score(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = mpeg_audio.read_media(mpeg_audio.store_media(table(spark, sf_dir, "documents")), keep=("n_bytes", "seek"))
    named = [F.concat(F.lit(f"{name}="), F.col(column).cast("string")) for name, column in (("frames", "frames"), ("samples", "samples"), ("rate", "sample_rate"), ("seconds", "duration_s"), ("crc_ok", "crc_ok"), ("crc_bad", "crc_bad"), ("skipped", "skipped_bytes"), ("table_frames", "table_frames"), ("kbit", "kbit_max"))]
    seek = F.concat(F.lit("seek="), F.crc32(F.array_join(F.col("frame_offsets").cast("array<string>"), ",").cast("binary")).cast("string"))
    size = F.octet_length("payload").cast("long")
    whole = F.when((size == F.col("payload_claimed")) & (F.col("seek") == F.col("frame_offsets")), size).otherwise(F.raise_error(F.lit("a stream lost payload bytes or frames")).cast("long"))
    return read.select(
        "doc_id", "n_bytes", whole.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat_ws(";", *named, seek).alias("feature"), "duration_s", "frames", "samples", "sample_rate", F.col("seek").alias("frame_offsets"),
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.fingerprint_edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("class_id").alias("component_id"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    placed = sharding.shard(table(spark, sf_dir, "documents"), text, size, 24, {"doc_id": F.col("doc_id"), "text_crc32": crc})
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    profiles = langid.learn(docs.filter(~held))
    return langid.identify(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(table(spark, sf_dir, "pages"))
    # Archive, offset and length depend on the compressor; SQL holds the order that the merge gives.
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "place")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustering.cluster(table(spark, sf_dir, "embeddings"), k=CLUSTERS, rounds=CLUSTER_ROUNDS, seed=2, dim=DIM)
    digests = clustering.centroid_digests(centroids)
    digest = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1) if digests else F.lit(None).cast("string")
    return found.withColumn("centroid_sha256", digest)


def op12_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signature_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", F.col("class_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pseudo_likelihood, op2_packing, op3_mpeg_audio, op4_minhash, op5_url_filter, op6_mixing, op7_simhash, op8_sharding, op9_langid, op10_warc, op11_clustering, op12_signature_join, op13_spelling)
}


def _nearest(centroids: str) -> str:
    return f"""SELECT v.vec_id, v.x, min({{'d': CAST(v.xx - 2 * list_inner_product(v.x, c.c) + list_inner_product(c.c, c.c) AS BIGINT), 'cluster': c.cluster}}) AS best
        FROM vectors v CROSS JOIN {centroids} c GROUP BY v.vec_id, v.x"""


def _cluster_sql(rounds: int) -> str:
    """Rounds of assigning and moving, spelled out."""
    steps = [f"""vectors AS MATERIALIZED (SELECT vec_id, x, list_inner_product(x, x) AS xx FROM (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
            WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM})),
        c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS INTEGER) AS cluster, x AS c FROM vectors
            ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x LIMIT {CLUSTERS})"""]  # fmt: skip
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({_nearest(f"c{r}")}),
        s{r} AS (SELECT best.cluster AS cluster, unnest(x) AS e, unnest(range({DIM})) AS pos FROM a{r}),
        m{r} AS (SELECT cluster, pos, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM s{r} GROUP BY cluster, pos),
        c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN
            (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS c FROM m{r} GROUP BY cluster) m ON o.cluster = m.cluster)""")  # fmt: skip
    return f"""WITH {", ".join(steps)}, final AS MATERIALIZED ({_nearest(f"c{rounds}")})
        SELECT f.vec_id, f.best.cluster AS cluster, f.best.d AS distance, CAST(sum(f.best.d) OVER (PARTITION BY f.best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(f.best.d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(list_transform(c.c, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
        FROM final f JOIN c{rounds} c ON f.best.cluster = c.cluster"""


def _crc_table() -> str:
    """What four bits do to a CRC-32, for each of their values."""
    values = list(range(16))
    for _ in range(4):
        values = [v >> 1 ^ (0xEDB88320 if v & 1 else 0) for v in values]
    return str(values)


_RULES = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op13_spelling": f"""
        WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00c0-\u00ff]+')) AS run FROM documents),
        own AS (SELECT run, count(*) AS times, hex(encode(id || ':' || run)) AS hx FROM runs WHERE length(run) >= 6 GROUP BY id, run),
        fours AS (SELECT run, times, list_transform(range(0, length(hx)), lambda i: CAST('0x' || substr(hx, i + 2 - 2 * (i % 2), 1) AS BIGINT)) AS b FROM own),
        hashed AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 4, {_crc_table()}[(xor(c, x) & 15) + 1])), 4294967295::BIGINT) AS h FROM fours),
        spelled AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
        words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
        cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        longer AS MATERIALIZED (SELECT DISTINCT c.word AS a, c.n AS an, w.word AS b, w.n AS bn FROM cut c JOIN words w ON c.rest = w.word),
        near AS (SELECT c.word AS a, d.word AS b, d.n AS bn FROM cut c JOIN cut d ON c.i = d.i AND c.rest = d.rest AND c.word <> d.word UNION ALL SELECT a, b, bn FROM longer UNION ALL SELECT b, a, an FROM longer),
        best AS (SELECT a, count(*) AS n_near, min({{'m': -bn, 'b': b}}) AS first FROM near GROUP BY a),
        forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -first.m >= 5 * w.n THEN first.b END AS form, CASE WHEN -first.m >= 5 * w.n THEN -first.m END AS form_n FROM words w LEFT JOIN best ON w.word = a),
        chain(word, via, depth) AS (SELECT word, word, 0 FROM words UNION ALL SELECT c.word, f.form, c.depth + 1 FROM chain c JOIN forms f ON c.via = f.word WHERE f.form IS NOT NULL),
        ends AS (SELECT word, arg_max(via, depth) AS root FROM chain GROUP BY word)
        SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN ends e ON f.word = e.word
    """,
    "op11_clustering": _cluster_sql(CLUSTER_ROUNDS),
    "op12_signature_join": r"""
        WITH RECURSIVE spelled AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        own AS MATERIALIZED (SELECT doc_id, list_sort(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM spelled),
        sets AS MATERIALIZED (SELECT s, min(doc_id) AS least, len(s) AS n FROM own WHERE len(s) > 0 GROUP BY s),
        held AS MATERIALIZED (SELECT least, n, unnest(s) AS g FROM sets),
        near AS MATERIALIZED (SELECT a.least AS x, b.least AS y FROM held a JOIN held b ON a.g = b.g AND a.least < b.least AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
            GROUP BY a.least, b.least, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        both_ways AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
        reach(node, seen) AS (SELECT least, least FROM sets UNION SELECT r.node, e.y FROM reach r JOIN both_ways e ON r.seen = e.x),
        roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
        SELECT o.doc_id, len(o.s) AS n_shingles, coalesce(r.root, o.doc_id) AS component_id, o.doc_id = coalesce(r.root, o.doc_id) AS kept
        FROM own o LEFT JOIN sets s ON o.s = s.s LEFT JOIN roots r ON s.least = r.node
    """,
    "op5_url_filter": f"""
        WITH rules(rhost, rpath, rule, verdict) AS (VALUES {_RULES}),
        rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
        cut AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
        fits AS (SELECT c.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.rule) DESC, length(r.rhost) DESC) AS n
            FROM cut c JOIN rules r ON (c.host = r.rhost OR ends_with(c.host, '.' || r.rhost)) AND starts_with(c.path, r.rpath))
        SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM cut c LEFT JOIN fits f ON c.page_id = f.page_id AND f.n = 1
    """,
    "op6_mixing": r"""
        WITH RECURSIVE sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
            md5('23:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest FROM documents),
        own AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM own),
        shares(n, source, source_size, weight, full_) AS (SELECT 0, source, source_size, weight, false FROM weighed UNION ALL
            SELECT n + 1, source, source_size, weight, full_ OR weight * ((total - 3.0 * held) / open) > 3.0 * source_size FROM (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
                CAST(sum(CASE WHEN full_ THEN source_size ELSE 0 END) OVER () AS DOUBLE) AS held, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () AS open, count(*) OVER () AS sources FROM shares) x WHERE n < sources),
        rates AS (SELECT source, source_size, CASE WHEN full_ THEN 3.0 * source_size ELSE weight * ((CAST(sum(source_size) OVER () AS DOUBLE) - 3.0 * CAST(sum(CASE WHEN full_ THEN source_size ELSE 0 END) OVER () AS DOUBLE))
            / sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ()) END::DOUBLE AS target FROM shares WHERE n = (SELECT max(n) FROM shares)),
        rated AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0 END::DOUBLE AS rate FROM rates),
        strata AS (SELECT *, lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(bin(size), 1, 4) AS stratum FROM sized),
        counts AS (SELECT source, stratum, sum(count(*)) OVER (PARTITION BY source ORDER BY stratum ROWS UNBOUNDED PRECEDING) AS upto, count(*) AS n FROM strata GROUP BY source, stratum),
        first AS (SELECT *, rate - floor(rate) AS f, CAST('0x' || substr(md5('23:' || coalesce('source ' || source, 'none')), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM rated),
        wanted AS (SELECT c.source, c.stratum, floor(f.f * upto + f.u) - floor(f.f * (upto - n) + f.u) AS wanted FROM counts c JOIN first f ON c.source IS NOT DISTINCT FROM f.source),
        numbered AS (SELECT source, stratum, digest, row_number() OVER (PARTITION BY source, stratum ORDER BY digest) AS k FROM strata),
        lasts AS (SELECT w.source, w.stratum, n.digest AS last FROM wanted w JOIN numbered n ON w.source IS NOT DISTINCT FROM n.source AND w.stratum = n.stratum AND n.k = w.wanted)
        SELECT s.doc_id, s.size, r.source_size, r.target, CAST(s.size * (floor(r.rate) + CASE WHEN s.digest <= l.last THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM strata s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN lasts l ON s.source IS NOT DISTINCT FROM l.source AND s.stratum = l.stratum
    """,
    "op10_warc": """
        WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS url,
            strftime(make_timestamp((1700000000 + CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 7) AS BIGINT) % 31536000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts FROM pages),
        rests AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE url END AS rest FROM d),
        hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS host FROM rests),
        names AS (SELECT *, regexp_replace(string_split(host, ':')[1], '^www\\.', '') AS name, CASE WHEN strpos(host, ':') > 0 THEN substr(host, strpos(host, ':') + 1) ELSE '' END AS port,
            regexp_extract(substr(rest, length(host) + 1), '^[^#]*') AS path FROM hosts),
        keyed AS (SELECT *, CASE WHEN url = '' THEN '' ELSE array_to_string(list_reverse(string_split(name, '.')), ',') || CASE WHEN port = '' THEN '' ELSE ':' || port END
            || ')' || CASE WHEN path = '' THEN '/' ELSE path END END AS urlkey FROM names),
        firsts AS (SELECT html, min(page_id) AS first FROM d GROUP BY html),
        j AS (SELECT k.page_id, strlen(k.html) AS payload_bytes, k.hex, f.first, urlkey, ts, row_number() OVER (ORDER BY urlkey, ts, k.page_id) - 1 AS place FROM keyed k JOIN firsts f ON k.html = f.html),
        digits AS (SELECT page_id, n, (CAST('0x' || substr(hex, (n // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (n % 4))) % 32 AS v FROM (SELECT DISTINCT page_id, hex FROM j) x, range(32) t(n)),
        b32 AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' ORDER BY n) AS payload_digest FROM digits GROUP BY page_id)
        SELECT j.page_id, payload_bytes, payload_digest, CASE WHEN j.page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN j.page_id > first THEN first END AS refers_to, urlkey, ts, place
        FROM j JOIN b32 ON j.page_id = b32.page_id
    """,
}
