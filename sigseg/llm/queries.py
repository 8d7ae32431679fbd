"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigseg.llm.alignment import cross_tokenizer_links
from sigseg.llm.bpe_automaton import bpe_encode
from sigseg.llm.chat_format import CHAT_SCHEMA, chat_calls, link_tool_calls
from sigseg.llm.language_id import identify, learn
from sigseg.llm.line_dedup import line_dedup
from sigseg.llm.merkle import merkle_manifest
from sigseg.llm.mixing import mix_sources
from sigseg.llm.near_dup import near_duplicates
from sigseg.llm.quality_rules import LONGS, MAX_COVERAGE, MAX_LINE_COVERAGE, MAX_SYMBOLS, repetition_coverage
from sigseg.llm.shared import Scratch
from sigseg.llm.substring_dedup import substring_dedup
from sigseg.llm.token_files import read_token_files, write_token_files
from sigseg.llm.toxicity import learn_toxicity, score_toxicity
from sigseg.llm.topk_search import quantize, topk_search, usable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings").filter(usable("embedding")).select("vec_id", quantize("embedding").alias("vector"))
    return topk_search(table, table.filter("vec_id % 50 = 0"), k=5)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = learn(docs.filter(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return out.select("doc_id", "n_chunks", "shared_chunks", "removed_chunks", "removed_chars", "first_docs", kept)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "block", "place")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def tokenizer_spec(path: str | None = None) -> str:
    """Content of a tokenizers file; by default the public byte-level BPE of 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = tokenizer_spec()
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode(docs, spec, packed=True, decoded="decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").path("shards")
    write_token_files(_table(spark, sf_dir, "documents"), tokenizer_spec(), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_tool_calls(*chat_calls(_table(spark, sf_dir, "conversations")), CHAT_SCHEMA)
    return out.select("conv_id", "call_id", "turn", "depth", "status", "valid", F.size("errors").alias("n_errors"), "json")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_coverage(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *LONGS, "base_failed", "too_many_symbols", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def piece_model(path: str | None = None) -> bytes:
    """Content of a sentencepiece model; by default the public one of 32,000 pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cross_tokenizer_links(_table(spark, sf_dir, "documents"), tokenizer_spec(), piece_model(), digest=True)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = learn_toxicity(docs, _table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("toxic").alias("label")))
    return score_toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted", F.size("sentences").alias("n_sentences"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest(_table(spark, sf_dir, "documents"), tampered)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_bpe_encode_decode": op6_bpe_encode_decode,
    "op7_chat_format": op7_chat_format,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_files": op10_token_files,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_WORDS = r"""w AS (
    SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
)"""


def _inside(width: int) -> str:
    """CTEs: the words inside windows of ``width`` words that a text holds twice, and their number and characters."""
    return f"""g{width} AS (
    SELECT doc_id, unnest(generate_series(1, len(ws) - {width - 1})) AS i, array_to_string(ws[i:i + {width - 1}], ' ') AS g FROM w WHERE len(ws) >= {width}
), t{width} AS (
    SELECT DISTINCT doc_id, i + unnest(generate_series(0, {width - 1})) AS i FROM g{width} WHERE (doc_id, g) IN (SELECT (doc_id, g) FROM g{width} GROUP BY doc_id, g HAVING count(*) > 1)
), c{width} AS (
    SELECT t.doc_id, count(*) AS words, sum(length(ws[i])) AS chars FROM t{width} t JOIN w ON t.doc_id = w.doc_id GROUP BY t.doc_id
)"""


def _quality_sql() -> str:
    limits = " AND ".join(f"coalesce(c{n}.chars, 0)::DOUBLE / greatest(word_chars, 1) <= {x}" for n, x in MAX_COVERAGE.items())
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = b.doc_id" for n in MAX_COVERAGE)
    return f"""
WITH {_WORDS}, {", ".join(map(_inside, MAX_COVERAGE))}, l AS (
    SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), k AS (
    SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), d AS (
    SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(length(line)) FILTER (again), 0) AS again_chars, sum(length(line)) AS line_chars FROM k GROUP BY doc_id
), b AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM w
), j AS (
    SELECT b.*, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c8.words, 0)::BIGINT AS n_repeat_words,
        n_words < 20 OR 100 * coalesce(c8.words, 0) > 30 * n_words AS base_failed,
        {limits} AND coalesce(again_chars, 0)::DOUBLE / greatest(coalesce(line_chars, 0), 1) <= {MAX_LINE_COVERAGE} AS fine
    FROM b LEFT JOIN d ON d.doc_id = b.doc_id {joins}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_symbols > {MAX_SYMBOLS}::DOUBLE * word_chars AS too_many_symbols, NOT base_failed AND fine AS kept FROM j
"""


def _field(name: str, value: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR END"


def _merkle_sql() -> str:
    def leaf(text: str) -> str:
        fields = [_field(n, text if n == "text" else n) for n in ("doc_id", "source", "lang", "n_chars", "text")]
        return f"sha256({' || '.join(fields)})"

    bits = "list_reduce([{}] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = "xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda s, c: " + bits.format("xor(s, c)") + "), 4294967295)"
    up = """SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM {0} WHERE n > 1 GROUP BY tree, level, idx // 3, n"""
    return f"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce('=' || source, '-') AS tree, {leaf("text")} AS leaf,
        CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS now FROM documents
), r AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d
), low(tree, level, idx, h, n) AS (
    SELECT tree, 0, idx, leaf, n FROM r UNION ALL {up.format("low")}
), sources AS (
    SELECT tree, h, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1
), high(tree, level, idx, h, n) AS (
    SELECT '*', 0, idx, h, n FROM sources UNION ALL {up.format("high")}
), steps AS (
    SELECT r.tree, r.idx, r.doc_id, r.leaf, l.level,
        string_agg(l.h, '' ORDER BY l.idx) FILTER (l.idx < r.idx // (3 ** l.level)::BIGINT) AS a, string_agg(l.h, '' ORDER BY l.idx) FILTER (l.idx > r.idx // (3 ** l.level)::BIGINT) AS b
    FROM r JOIN low l ON l.tree = r.tree AND l.idx // 3 = r.idx // (3 ** (l.level + 1))::BIGINT WHERE l.n > 1 GROUP BY ALL
    UNION ALL
    SELECT r.tree, r.idx, r.doc_id, r.leaf, s.height + h.level,
        string_agg(h.h, '' ORDER BY h.idx) FILTER (h.idx < s.idx // (3 ** h.level)::BIGINT), string_agg(h.h, '' ORDER BY h.idx) FILTER (h.idx > s.idx // (3 ** h.level)::BIGINT)
    FROM r JOIN sources s ON s.tree = r.tree JOIN high h ON h.idx // 3 = s.idx // (3 ** (h.level + 1))::BIGINT WHERE h.n > 1 GROUP BY ALL
), lists AS (
    SELECT tree, idx, list({{'a': coalesce(a, ''), 'b': coalesce(b, '')}} ORDER BY level) AS sides FROM steps GROUP BY ALL
), folded AS (
    SELECT r.*, s.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(array_to_string(list_transform(sides, lambda x: x.a || x.b), ''), '') AS proof,
        list_reduce([now] || coalesce(list_transform(sides, lambda x: x.a || '.' || x.b), []), lambda x, y: sha256(split_part(y, '.', 1) || x || split_part(y, '.', 2))) AS folded_root
    FROM r JOIN sources s ON s.tree = r.tree LEFT JOIN lists l ON l.tree = r.tree AND l.idx = r.idx
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


ORACLE_SQL: dict[str, str] = {
    "op13_merkle_manifest": _merkle_sql(),
    "op5_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS g FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), near AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, near.b FROM reach JOIN near ON near.a = reach.r
), c AS (
    SELECT d, min(r) AS component_id FROM reach GROUP BY d
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c ON c.d = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
""",
    "op8_quality_rules": _quality_sql(),
    "op1_exact_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
""",
    "op7_chat_format": """
WITH RECURSIVE t AS (
    SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM conversations
), system AS (
    SELECT conv_id, turn + 1 AS turn, min(text) AS system FROM t WHERE role = 'system' GROUP BY ALL
), calls AS (
    SELECT t.conv_id, 'call_' || t.turn AS call_id, t.turn, t.text AS prompt, s.system,
        CASE WHEN t.turn > 0 THEN 'call_' || (t.turn - 2) END AS after,
        row_number() OVER (PARTITION BY t.conv_id, t.turn ORDER BY t.text) AS n
    FROM t LEFT JOIN system s USING (conv_id, turn) WHERE role = 'user'
), results AS (
    SELECT conv_id, 'call_' || (turn - 1) AS call_id, turn AS result_turn, text AS content,
        row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS n
    FROM t WHERE role = 'assistant'
), depths AS (
    SELECT conv_id, call_id, 0::BIGINT AS depth FROM calls c
    WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.call_id = c.after)
    UNION ALL
    SELECT c.conv_id, c.call_id, d.depth + 1 FROM depths d JOIN calls c ON c.conv_id = d.conv_id AND c.after = d.call_id AND c.n = 1
), linked AS (
    SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.n, r.n) AS n, c.turn, r.result_turn,
        c.turn IS NOT NULL AS is_call, prompt, system, content,
        CASE WHEN c.turn IS NOT NULL AND prompt IS NULL THEN ['prompt is missing'] ELSE [] END AS errors
    FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id AND c.n = r.n
), done AS (
    SELECT l.*, d.depth, is_call AND len(errors) = 0 AS valid,
        CASE WHEN n > 1 THEN 'duplicate' WHEN NOT is_call THEN 'no_call' WHEN result_turn IS NULL THEN 'no_result' ELSE 'linked' END AS status
    FROM linked l LEFT JOIN depths d ON l.conv_id = d.conv_id AND l.call_id = d.call_id
)
SELECT conv_id, call_id, coalesce(turn, result_turn) AS turn, depth, status, valid, len(errors)::INTEGER AS n_errors,
    '{"arguments":' || CASE WHEN NOT is_call THEN 'null' ELSE '{'
        || array_to_string(list_filter(['"prompt":' || to_json(prompt)::VARCHAR, '"system":' || to_json(system)::VARCHAR, '"turn":' || turn], lambda x: x IS NOT NULL AND x NOT LIKE '%:null'), ',') || '}' END
    || ',"call_id":' || to_json(call_id)::VARCHAR || ',"content":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"depth":' || coalesce(depth::VARCHAR, 'null')
    || ',"errors":' || to_json(errors)::VARCHAR || ',"name":' || CASE WHEN is_call THEN '"respond"' ELSE 'null' END
    || ',"status":"' || status || '","valid":' || CASE WHEN valid THEN 'true' ELSE 'false' END || '}' AS json
FROM done
""",
    "op9_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
    FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), keyed AS (
    SELECT doc_id, i, line, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS bare FROM lines
), keys AS (
    SELECT doc_id, i, line, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM keyed
), counts AS (
    SELECT k, max(doc_id) AS holder FROM keys WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT keys.doc_id, i, line, counts.k IS NOT NULL AND keys.doc_id <> counts.holder AS gone FROM keys LEFT JOIN counts ON keys.k = counts.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
