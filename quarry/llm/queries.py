"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html, lzprint, mixing, neighbours, ominhash, pseudolm, quality, simplex, toxicity, warc, wavelet
from .tables import remainder_of_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOXIC_FROM, QUALITY_FROM = 0.7, 0.3


#: Escapes and layout of the chat template, as DuckDB writes them.
_ESCAPED = "regexp_replace({0}, '<(\\|+)', '<\\1|', 'g')"
ORACLES["op7_chat"] = f"""
WITH t AS (
  SELECT conv_id, false AS added, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, true, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, true, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
c AS (
  SELECT conv_id, added, count(*) AS n,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text) AS roles,
    sum(24 + length(replace({_ESCAPED.format('role')}, chr(10), '<|n|>')) + length({_ESCAPED.format('text')})) AS chars
  FROM t GROUP BY conv_id, added)
SELECT conv_id, n AS n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars,
  regexp_matches(roles, '^(system,)?user(,assistant,user)*(,assistant)?$') AS valid FROM c"""

#: Packets in the order of their finish times, cut where all sizes are taken; targets beside it by running sums over the sources.
ORACLES["op9_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':5'), 1, 15) AS BIGINT) AS place, row_number() OVER () AS id FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER low, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER low, 0)) AS rate
      FROM w WINDOW low AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT rate FROM r WHERE rate <= cap / weight ORDER BY cap / weight, k LIMIT 1),
g AS (SELECT source, source_size, weight, least(cap, (SELECT rate FROM f) * weight) AS target FROM r),
q AS (SELECT d.*, g.source_size, g.weight, g.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size
        ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
o AS (SELECT id, source, weight, least(128, size - p * 128) AS offer, before + n * source_size + p * 128 + least(128, size - p * 128) AS until
      FROM q, generate_series(0, 2) AS a(n), LATERAL (SELECT unnest(generate_series(0, (size + 127) // 128 - 1)) AS p) WHERE size > 0),
c AS (SELECT *, sum(offer) OVER (ORDER BY until / weight, source NULLS FIRST, until ROWS UNBOUNDED PRECEDING) AS position FROM o),
t AS (SELECT id, sum(offer - greatest(position - (SELECT sum(size) FROM d), 0)) AS taken FROM c
      WHERE position - offer < (SELECT sum(size) FROM d) GROUP BY id)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN t USING (id)"""

#: Equal payloads of 100 bytes or more refer to the one with the least id.
ORACLES["op11_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS lead FROM p
      WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END
  AS record_type, CASE WHEN place > 1 AND payload_bytes >= 100 THEN lead END AS refers_to FROM r"""

#: Lines by splitting at line ends.
ORACLES["op12_fim"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
n AS (SELECT *, CAST(CASE WHEN t = '' THEN 0 WHEN t LIKE '%' || chr(10) THEN len(parts) - 1 ELSE len(parts) END AS BIGINT) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
e AS (SELECT *, CASE WHEN lo = 0 THEN '' WHEN lo < len(parts) THEN array_to_string(parts[1:lo], chr(10)) || chr(10) ELSE t END AS head,
    CASE WHEN hi = 0 THEN '' WHEN hi < len(parts) THEN array_to_string(parts[1:hi], chr(10)) || chr(10) ELSE t END AS upto FROM c),
p AS (SELECT *, substr(upto, length(head) + 1) AS middle, substr(t, length(upto) + 1) AS tail FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle
    WHEN 'spm' THEN '<S>' || tail || '<P>' || head || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


def _simplex_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds of the clustering, every vector against every centroid."""
    assigned = """a{i} AS MATERIALIZED (SELECT v.r, min(struct_pack(d := v.s - 2 * list_inner_product(v.x, c.x) + c.s, c := c.c)) AS m
  FROM v, (SELECT c, x, list_inner_product(x, x) AS s FROM c{i}) AS c GROUP BY v.r)"""
    moved = """c{j} AS MATERIALIZED (SELECT c, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN (
  SELECT c, list(floor(total / n) ORDER BY pos) AS x FROM (
    SELECT a{i}.m.c AS c, pos, sum(v.x[pos]) AS total, count(*) AS n FROM a{i} JOIN v USING (r), generate_series(1, 64) AS g(pos)
    GROUP BY ALL) GROUP BY c) AS m USING (c))"""
    steps = [text.format(i=i, j=i + 1) for i in range(rounds) for text in (assigned, moved)] + [assigned.format(i=rounds)]
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, x, list_inner_product(x, x) AS s, row_number() OVER () AS r FROM (
    SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64)),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (
    SELECT x, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, x LIMIT {k})),
{", ".join(steps)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance,
  CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(f.x, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} AS f ON f.c = m.c"""


ORACLES["op13_simplex"] = _simplex_sql()


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN).drop("text")
    return bpe.decode_documents(encoded, VOCABULARY).select(
        "doc_id", "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on the rows that the contract lets it learn from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.fit(toxicity.labelled_documents(docs, labels, "toxic", remainder_of_id("doc_id", 3) != 1,
                                                    toxicity.FIT_ROWS))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.RuleModel:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.fit(toxicity.labelled_documents(docs, labels, "quality", remainder_of_id("doc_id", 5) != 0,
                                                   quality.FIT_ROWS))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the factorization machine."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (remainder_of_id("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the rule ensemble."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_documents(docs, quality_model(spark, sf_dir))
    return scored.select("doc_id", (remainder_of_id("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, read back from the output and digested."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", F.lit(False).alias("added"))
    says = F.lit("<|im_end|><|im_start|>assistant ok")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  says.alias("text"), F.lit(True).alias("added"))
    laid = chat.format_conversations(turns.unionByName(added), by=("conv_id", "added"))
    read = laid.select("conv_id", "valid", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "valid")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    sized = mixing.sized_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    took = mixing.mix(sized).groupBy("row").agg(F.sum("take").alias("taken"))
    goals = mixing.targets(sized).drop("weight").withColumnRenamed("source", "of")
    return (sized.join(took, "row", "left").join(goals, F.col("source").eqNullSafe(F.col("of")))
            .select("doc_id", "size", "source_size", F.round("target", 6).alias("target"),
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


@query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", "n_chars")


@query
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    return neighbours.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


@query
def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return lzprint.chained(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return ominhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document under the network trained on all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = pseudolm.vocabulary(docs)
    frequent = [w for w, _ in pseudolm.frequent_words(docs, words=words)]
    return pseudolm.score_documents(docs, frequent, pseudolm.fit(docs, frequent), vocabulary=words)


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through legacy archives into WARC records and back."""
    return warc.archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at lines and put together with its middle last, and the text rebuilt from that."""
    made = wavelet.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = wavelet.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


@query
def op13_simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings after five rounds."""
    return simplex.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
