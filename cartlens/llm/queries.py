"""One registered query for each operator, over its whole table, and DuckDB texts where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm import bpe, credentials, itq, langid, lexical, mixing, orderhash, packing, pii, quality, topk, turntrie, warc
from cartlens.llm.storage import bound_batches, drop, new_folder, sweep


# Conversations of one group begin alike: with the first turns of the first of them, up to HEADS - 1.
GROUP, HEADS = 5, 9


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _joined(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def span_digests(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts and digest of the base kinds, and all spans, of rows with an id and spans."""
    listed = ", ".join(f"'{k}'" for k in kinds)
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in kinds]
    base = found.withColumn("base", F.expr(f"filter(spans, x -> x.kind in ({listed}))"))
    return base.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans")
    )


def held_out(column: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(column).cast("string")) % 4 == 2


def quality_field(spark: SparkSession, folder: str, documents: DataFrame) -> quality.Field:
    """The field learned from the labels of documents that are not held out."""
    labels = _table(spark, folder, "labels").where(~held_out())
    return quality.fit(documents, labels, "doc_id", "text", "quality")


def packed(documents: DataFrame) -> DataFrame:
    """Pieces of the packed sequences with a checksum in place of their ids."""
    return packing.pack(documents, "doc_id", "text").selectExpr(
        "doc_id", "start", "length", "crc32(ids) as ids_crc32", "doc_tokens", "sequence_id", "`offset`"
    )


def op1_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(_table(spark, folder, "documents"))


def op2_segment_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op3_linked_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return span_digests(credentials.spans(_table(spark, folder, "documents"), "doc_id", "text"), credentials.BASE)


def op4_itq_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return itq.neighbours(_table(spark, folder, "embeddings"), "vec_id", "embedding", "label")


def op5_trie_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(_table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def op6_line_field_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    field = quality_field(spark, folder, documents)
    return documents.select("doc_id", held_out().alias("held_out"), quality.score("text", field).alias("score")).withColumn(
        "predicted", F.expr(f"if(score >= {quality.GOOD_AT}, 1, 0)")
    )


def op7_evidence_language(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of `documents` and of `pages`, with all kinds of evidence counted over both: documents have a host, and a domain and suffix where
    it is a host name; pages have declared languages too. A row has a doc_id or a page_id."""
    documents, pages = _table(spark, folder, "documents"), _table(spark, folder, "pages")
    languages, model = langid.fit(documents, "doc_id", "text", "lang")
    sources, addresses = langid.host_evidence(F.col("source")), langid.page_evidence()
    both = documents.select("doc_id", "text", *[c.alias(name) for name, c in sources.items()]).unionByName(
        pages.select("page_id", langid.page_text().alias("text"), *[c.alias(name) for name, c in addresses.items()]), allowMissingColumns=True
    )
    rows = both.withColumn("id", F.struct("doc_id", "page_id"))
    found = langid.identify(rows, "id", "text", languages, model, **{name: F.col(name) for name in addresses})
    return found.select("id.doc_id", "language", "confidence", "margin", "text_language", "rejected", "id.page_id")


def language_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The same operator over `pages` alone."""
    languages, model = langid.fit(_table(spark, folder, "documents"), "doc_id", "text", "lang")
    pages = _table(spark, folder, "pages")
    evidence = langid.page_evidence()
    rows = pages.select("page_id", langid.page_text().alias("text"), *[c.alias(name) for name, c in evidence.items()])
    found = langid.identify(rows, "page_id", "text", languages, model, **{name: F.col(name) for name in evidence})
    return found.withColumnRenamed("id", "page_id")


def op8_warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    archives = new_folder(spark, "warc")
    shared = warc.shared_payloads(pages)
    warc.write_archives(warc.with_types(pages, shared=shared), archives)
    drop(shared)
    sweep(spark)
    bound_batches(spark)
    return warc.captures(warc.read_records(spark, archives)).select(
        F.expr("cast(metadata.fields['captureId'] as bigint)").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.expr("cast(metadata.fields['refersToCapture'] as bigint)").alias("refers_to"),
    )


def op9_contextual_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.spans(_table(spark, folder, "documents"), "text", ["doc_id"])
    return span_digests(found.select(F.col("carried.doc_id").alias("id"), "spans"), pii.BASE)


def op10_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return orderhash.classes(_table(spark, folder, "documents"), "doc_id", "text")


def op11_hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents"), "doc_id", "text", _table(spark, folder, "benchmark"), "item_id", "text")


def op12_turn_trie(spark: SparkSession, folder: str) -> DataFrame:
    keys = turntrie.conversation_keys(_table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    return turntrie.trie(turntrie.rebuilt(keys, GROUP, HEADS))


def op13_budget_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"), "doc_id", "text", "source").select(
        "doc_id", "size", "source_size", "target", "taken", "source", "whole", "part"
    )


_USABLE = """
usable AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""

OP2_SQL = f"""
WITH {_USABLE},
whole AS (SELECT vec_id, list_transform(v, lambda x: floor(1024 * x)) AS v FROM usable),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP4_SQL = f"""
WITH RECURSIVE {_USABLE},
alike AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_inner_product(a.v, a.v) > 0 AND list_inner_product(b.v, b.v) > 0
      AND list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= {itq.THRESHOLD}
),
reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT r.a, l.b FROM reach r JOIN alike l ON r.b = l.a
),
counts AS (SELECT a, count(*) AS n FROM alike GROUP BY a),
least_ids AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, m.component_id, m.component_id = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least_ids m ON m.a = e.vec_id
"""

OP8_SQL = """
WITH hashed AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
),
coded AS (
    SELECT page_id, payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(hex, CAST(i // 8 AS BIGINT) * 10 + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT) + 1, 1)
        ), '') AS payload_digest
    FROM hashed
),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM coded)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < last THEN last END AS refers_to
FROM grouped
"""

OP11_SQL = r"""
WITH terms AS (
    SELECT row_number() OVER () AS r, doc_id,
        list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
            lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS t
    FROM documents WHERE text IS NOT NULL
),
docs AS (SELECT r, doc_id, t, len(t) AS n FROM terms WHERE len(t) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
asked AS (
    SELECT DISTINCT i, item_id, unnest(t) AS term FROM (
        SELECT row_number() OVER () AS i, item_id,
            list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS t
        FROM benchmark WHERE text IS NOT NULL)
),
postings AS (
    SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM docs)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM postings, totals GROUP BY term
),
scored AS (
    SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
    FROM postings JOIN weights USING (term) JOIN asked USING (term), totals GROUP BY i, item_id, r, doc_id
),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

OP12_SQL = f"""
WITH turns AS (
    SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id, strlen(coalesce(text, '')) AS size,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
),
lists AS (SELECT conv_id, list({{'id': id, 'size': size}} ORDER BY place) AS l FROM turns GROUP BY conv_id),
-- The checksum of the decimal number, bit by bit.
heads AS (
    SELECT conv_id, l, xor(list_reduce(
        list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))
    ), 4294967295) % {HEADS} AS h FROM lists
),
built AS (
    SELECT c.conv_id, list_concat(coalesce(t.l[1:c.h], []), c.l[c.h + 1:]) AS l
    FROM heads c LEFT JOIN heads t ON t.conv_id = c.conv_id - c.conv_id % {GROUP}
),
prefixes AS (SELECT conv_id, len(l) AS n, d, l[1:d] AS p FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM built)),
nodes AS (
    SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
    FROM prefixes GROUP BY p, d
),
children AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (
    SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * n.p[n.d].size END AS saves
    FROM nodes n LEFT JOIN children c ON c.p = n.p AND c.d = n.d
),
above AS (
    SELECT p[1:a] AS p, a AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saves) AS saved
    FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY ALL
)
SELECT c.conv_id, CAST(c.d AS BIGINT) AS depth, m.conv_id AS parent_conv_id, c.n_convs, CAST(c.n_children AS BIGINT) AS n_children,
    CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN above a ON a.p = c.p AND a.d = c.d LEFT JOIN nodes m ON c.d > 0 AND m.p = c.p[1:c.d - 1] AND m.d = c.d - 1
"""

OP13_SQL = rf"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        md5(concat('{mixing.SEED}:', coalesce(CAST(doc_id AS VARCHAR), concat('text:', coalesce(text, ''))))) AS key
    FROM documents
),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized GROUP BY source
),
weighed AS (SELECT *, {list(mixing.WEIGHTS)}[number % {len(mixing.WEIGHTS)} + 1] AS weight, {mixing.EPOCHS} * source_size AS most FROM sources),
rounds AS (
    SELECT 0 AS step, CAST(sum(source_size) AS HUGEINT) AS rest, CAST(sum(weight) AS HUGEINT) AS weight FROM weighed
    UNION ALL
    SELECT r.step + 1,
        CAST((SELECT sum(source_size) FROM weighed) - coalesce(sum(w.most) FILTER (WHERE w.most * r.weight < w.weight * r.rest), 0) AS HUGEINT),
        CAST(coalesce(sum(w.weight) FILTER (WHERE w.most * r.weight >= w.weight * r.rest), 0) AS HUGEINT)
    FROM rounds r, weighed w WHERE r.step <= (SELECT count(*) FROM weighed) AND r.weight > 0 GROUP BY r.step
),
settled AS (SELECT * FROM rounds ORDER BY step DESC LIMIT 1),
targets AS (
    SELECT w.source, source_size, CASE WHEN s.weight > 0 AND source_size > 0
        THEN least(CAST(rest AS DOUBLE) * w.weight / CAST(s.weight AS DOUBLE), CAST(most AS DOUBLE)) ELSE CAST(most AS DOUBLE) END AS target
    FROM weighed w, settled s
),
placed AS (
    SELECT doc_id, d.source, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS before
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
),
cut AS (
    SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole,
        CASE WHEN source_size > 0 THEN greatest(0, least(size, budget % source_size - before)) ELSE 0 END AS part
    FROM placed
)
SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken, source, CAST(whole AS BIGINT) AS whole, CAST(part AS BIGINT) AS part
FROM cut
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_retrieval_packing,
        op2_segment_top_k,
        op3_linked_secrets,
        op4_itq_neighbours,
        op5_trie_bpe,
        op6_line_field_quality,
        op7_evidence_language,
        language_of_pages,
        op8_warc_transactions,
        op9_contextual_pii,
        op10_order_minhash,
        op11_hybrid_search,
        op12_turn_trie,
        op13_budget_mix,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_segment_top_k": OP2_SQL,
        "op4_itq_neighbours": OP4_SQL,
        "op8_warc_transactions": OP8_SQL,
        "op11_hybrid_search": OP11_SQL,
        "op12_turn_trie": OP12_SQL,
        "op13_budget_mix": OP13_SQL,
    }
