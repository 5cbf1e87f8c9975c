"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, centroids, conversations, embedding_dedup, id_planes, language_id, licenses, near_dedup, packing, quality_model, quality_rules, secrets, toxicity
from quire.llm.cluster import Shelf, held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs)).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    places = F.transform("base", lambda x: x["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(F.transform("base", lambda x: x["label"])).alias("base_labels"),
        joined(F.concat(F.transform("base", lambda x: x["label"]), F.transform("spans", lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["covered"])), F.lit(0.0)).alias("score"),
    )


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit_cutoffs(docs, table(spark, sf_dir, "labels")))


def op11_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Shelf(spark).folder}/ids"
    id_planes.write(id_planes.ordered(table(spark, sf_dir, "documents")), folder, public_tokenizers.path("word_bpe_49k.json"))
    return id_planes.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")), kept="kept")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_secret_scan, op4_minhash_near_dedup, op5_byte_bpe, op6_embedding_near_dedup, op7_license_scan, op8_quality_model, op9_packing, op10_quality_rules, op11_id_planes, op12_centroids, op13_conversation_repair)}


def _rounds(n: int) -> str:
    """Centroids (c, k) after n rounds, as chained tables c0, c1, ...; a component is one row (c, j, x)."""
    steps = []
    for r in range(n + 1):
        steps.append(f"""
        d{r} AS MATERIALIZED (SELECT v.id, c.c, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM comp v JOIN c{r} c USING (j) GROUP BY v.id, c.c),
        a{r} AS MATERIALIZED (SELECT id, min({{'distance': distance, 'c': c}}) AS got FROM d{r} GROUP BY id)""")
        if r < n:
            steps.append(f"""
        s{r} AS MATERIALIZED (SELECT a.got.c AS c, v.j, sum(v.x) AS s, count(*) AS n FROM comp v JOIN a{r} a USING (id) GROUP BY a.got.c, v.j),
        c{r + 1} AS MATERIALIZED (SELECT c.c, c.j, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, c.x) AS x FROM c{r} c LEFT JOIN s{r} s ON s.c = c.c AND s.j = c.j)""")
    return ",".join(steps)


ORACLE: dict[str, str] = {
    "op12_centroids": f"""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        comp AS MATERIALIZED (SELECT id, unnest(range(64)) AS j, CAST(floor(unnest(embedding)::DOUBLE * 1024) AS HUGEINT) AS x FROM kept),
        c0 AS MATERIALIZED (SELECT s.c, v.j, v.x FROM comp v JOIN (SELECT id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY c < 8) s USING (id)),
        {_rounds(10)},
        named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c10 GROUP BY c)
        SELECT k.vec_id, CAST(a.got.c AS INTEGER) AS cluster, CAST(a.got.distance AS BIGINT) AS distance,
            CAST(sum(a.got.distance) OVER (PARTITION BY a.got.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.got.distance) OVER () AS BIGINT) AS inertia, n.centroid_sha256
        FROM kept k JOIN a10 a USING (id) JOIN named n ON n.c = a.got.c""",
    "op13_conversation_repair": rf"""
        WITH RECURSIVE code AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
        named AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, row_number() OVER () AS place FROM conversations),
        hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: CAST(ord(substr(name, i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS fault FROM named, code),
        damaged AS MATERIALIZED (SELECT conv_id, turn, place, CASE WHEN fault = 4 THEN 'user' ELSE r END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS text
            FROM hashed, range(2) c(copy) WHERE fault <> 0 AND (fault = 3 OR copy = 0)),
        numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS initial, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS words FROM damaged),
        judged AS MATERIALIZED (SELECT *, CASE WHEN words = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(words, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial NOT IN ('su', 'ua', 'au') AND n > 1 AS illegal FROM numbered),
        -- The cheapest (cost, audit) to reach each state before row n + 1, insertions after row n included.
        scan AS (
            SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': ''}} AS z, {{'c': 99999999::BIGINT, 'a': ''}} AS s, {{'c': 3::BIGINT, 'a': 'I'}} AS u, {{'c': 6::BIGINT, 'a': 'II'}} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, n, z, s, least(u, {{'c': z.c + 3, 'a': z.a || 'I'}}, {{'c': s.c + 3, 'a': s.a || 'I'}}, {{'c': a.c + 3, 'a': a.a || 'I'}}),
                least(a, {{'c': z.c + 6, 'a': z.a || 'II'}}, {{'c': s.c + 6, 'a': s.a || 'II'}}, {{'c': u.c + 3, 'a': u.a || 'I'}})
            FROM (SELECT o.conv_id, j.n, {{'c': z.c + 4, 'a': z.a || 'D'}} AS z,
                least({{'c': s.c + 4, 'a': s.a || 'D'}}, {{'c': z.c + keep.s, 'a': z.a || 'K'}}) AS s,
                least({{'c': u.c + 4, 'a': u.a || 'D'}}, {{'c': z.c + keep.u, 'a': z.a || 'K'}}, {{'c': s.c + keep.u, 'a': s.a || 'K'}}, {{'c': a.c + keep.u, 'a': a.a || 'K'}},
                    {{'c': z.c + free, 'a': z.a || 'R'}}, {{'c': s.c + free, 'a': s.a || 'R'}}, {{'c': a.c + free, 'a': a.a || 'R'}}) AS u,
                least({{'c': a.c + 4, 'a': a.a || 'D'}}, {{'c': u.c + keep.a, 'a': u.a || 'K'}}, {{'c': u.c + free, 'a': u.a || 'R'}}) AS a
                FROM scan o JOIN (SELECT conv_id, n, free, {{'s': CASE WHEN initial = 's' THEN free - 3 ELSE 99999999 END, 'u': CASE WHEN initial = 'u' THEN free - 3 ELSE 99999999 END, 'a': CASE WHEN initial = 'a' THEN free - 3 ELSE 99999999 END}} AS keep
                    FROM (SELECT *, CASE fault WHEN 'blank' THEN 99999999 WHEN 'duplicate' THEN 99999999 WHEN 'truncated' THEN 6 ELSE 3 END AS free FROM judged)) j
                ON j.conv_id IS NOT DISTINCT FROM o.conv_id AND j.n = o.n + 1)),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, max(n) AS n FROM judged GROUP BY conv_id),
        ended AS MATERIALIZED (SELECT o.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, least(z, a) AS best FROM scan o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id WHERE o.n = coalesce(c.n, 0)),
        edits AS (SELECT conv_id, i, substr(best.a, i, 1) AS edit, length(replace(left(best.a, i), 'I', '')) AS n, length(replace(left(best.a, i), 'D', '')) AS line FROM (SELECT *, unnest(range(1, length(best.a) + 1)) AS i FROM ended)),
        turns AS (SELECT e.conv_id, e.line, e.edit, e.edit = 'K' AND j.initial = 's' AS is_s, j.role, CASE WHEN e.edit = 'I' THEN '' ELSE j.text END AS text FROM edits e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.n = e.n AND e.edit <> 'I' WHERE e.edit <> 'D'),
        roled AS (SELECT conv_id, line, CASE WHEN edit = 'K' THEN role WHEN (line + CAST(bool_or(is_s) OVER (PARTITION BY conv_id) AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, text FROM turns),
        told AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY line) AS repaired FROM roled GROUP BY conv_id)
        SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            best.c AS cost, best.a AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256 FROM ended e LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM e.conv_id""",
}
