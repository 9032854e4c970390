"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession

from . import annindex, bpe, common, decontaminate, dialogue, longrepeats, merkle, pieces, pii, sharding, simhash, tokenstore, toxicity, warc


def tokenizer_file(name: str) -> tuple[str, str]:
    """A public vocabulary's place and the pattern that goes with the rank files."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(common.table(spark, sf_dir, "pages"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.token_round_trip(common.table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")[0])


def pii_secret(spark: SparkSession) -> pii.Secret:
    """The key that the session's ``spark.quadrat.pii.secret`` holds (Spark redacts settings of such names).

    Where it is unset, the session gets a random one: pseudonyms are then linked within the session only, and nobody can undo them after it.
    """
    name = "spark.quadrat.pii.secret"
    if not spark.conf.get(name, ""):
        spark.conf.set(name, secrets.token_hex(32))
    return pii.Secret(spark.conf.get(name))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(common.table(spark, sf_dir, "documents"), pii_secret(spark))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annindex.nearest_of_every_fiftieth(common.table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(common.table(spark, sf_dir, "documents"))


def op8_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longrepeats.remove_repeats(common.table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(common.table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(common.table(spark, sf_dir, "documents"), *tokenizer_file("byte_bpe_multi_50k.tiktoken"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(common.table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")[0])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(common.table(spark, sf_dir, "documents"), merkle.without_line_feeds())


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_report(common.table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_warc, op3_token_ids, op4_pii, op5_toxicity, op6_nearest, op7_sharding, op8_long_repeats, op9_simhash, op10_byte_bpe, op11_sentencepiece, op12_merkle_manifest, op13_conversation_repair)}


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string: bytes are exclusive-ored in, each followed by eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT)"


def _crc32_bytes(text: str) -> str:
    """The same for any text's UTF-8 bytes."""
    steps = f"flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: [('0x' || h)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT)"


def _edit(cost: str, letter: str, then: str) -> str:
    return f"{{'c': {then}.c + {cost}, 'a': '{letter}' || {then}.a}}"


def _leaf(text: str) -> str:
    """SQL for a document's leaf with that text: values with their lengths in bytes before them."""
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


# The grammar as four states (before anything, after s, after u, after a): from the last turn to the first, the cheapest
# (cost, audit) of each. Insertions follow at most two in a row.
_STEP = {
    "v0": f"list_min([{_edit('2', 'D', 'v0')}, CASE WHEN t = 'd' THEN far WHEN lower(t) = 's' THEN {_edit('f', 'K', 'v1')} ELSE far END, CASE WHEN t = 'd' THEN far WHEN lower(t) = 'u' THEN {_edit('f', 'K', 'v2')} ELSE {_edit('f + 1', 'R', 'v2')} END])",
    "v1": f"list_min([{_edit('2', 'D', 'v1')}, CASE WHEN t = 'd' THEN far WHEN lower(t) = 'u' THEN {_edit('f', 'K', 'v2')} ELSE {_edit('f + 1', 'R', 'v2')} END])",
    "v2": f"list_min([{_edit('2', 'D', 'v2')}, CASE WHEN t = 'd' THEN far WHEN lower(t) = 'a' THEN {_edit('f', 'K', 'v3')} ELSE {_edit('f + 1', 'R', 'v3')} END])",
    "v3": f"list_min([{_edit('2', 'D', 'v3')}, CASE WHEN t = 'd' THEN far WHEN lower(t) = 'u' THEN {_edit('f', 'K', 'v2')} ELSE {_edit('f + 1', 'R', 'v2')} END])",
}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op1_decontamination": f"""WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 win AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS v FROM (SELECT *, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM iw WHERE len(w) > 0)),
 ns AS (SELECT DISTINCT n FROM win), dg AS (SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS v FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM dw, ns WHERE len(w) >= n)),
 hit AS (SELECT DISTINCT r, i, dg.n, item_id FROM dg JOIN win ON dg.n = win.n AND dg.v = win.v),
 pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, i + unnest(range(n)) AS p FROM hit) GROUP BY 1),
 ids AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)""",
    "op2_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), m AS (SELECT html, max(page_id) AS top FROM p WHERE strlen(html) >= 1000 GROUP BY 1)
 SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM p LEFT JOIN m ON p.html = m.html""",
    "op7_sharding": f"""WITH b AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, {_crc32_bytes("coalesce(text, '')")} AS text_crc32 FROM documents), o AS (SELECT *, sum(size) OVER w - size AS off, sum(size) OVER () AS total FROM b WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT *, least(CAST(off * 40 AS HUGEINT) // CAST(total AS HUGEINT), 39)::INTEGER AS shard FROM o) SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY off) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s""",
    "op12_merkle_manifest": f"""WITH RECURSIVE l AS (SELECT row_number() OVER () AS r, doc_id, source, {_leaf("text")} AS leaf, {_leaf("CASE WHEN " + _crc32("doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS false_leaf FROM documents),
 o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
 t AS (SELECT source, 0 AS lvl, pos, leaf AS node, n FROM o UNION ALL SELECT source, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
 s AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
 u AS (SELECT 0 AS lvl, pos, subroot AS node, n FROM s UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, pos // 3, n),
 tr AS (SELECT source, lvl, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM t WHERE n > 1 GROUP BY ALL), ur AS (SELECT lvl, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM u WHERE n > 1 GROUP BY ALL),
 step AS (SELECT r, lvl AS k, nodes, (o.pos // pow(3, lvl)::BIGINT) % 3 AS i FROM o JOIN tr ON tr.source IS NOT DISTINCT FROM o.source AND tr.run = o.pos // pow(3, lvl + 1)::BIGINT
  UNION ALL SELECT r, 1000 + lvl, nodes, (s.pos // pow(3, lvl)::BIGINT) % 3 FROM o JOIN s ON s.source IS NOT DISTINCT FROM o.source JOIN ur ON ur.run = s.pos // pow(3, lvl + 1)::BIGINT),
 p AS (SELECT r, list({{'b': array_to_string(nodes[:i], ''), 'a': array_to_string(nodes[i + 2:], ''), 'c': ''}} ORDER BY k) AS path FROM step GROUP BY 1),
 f AS (SELECT doc_id, leaf, subroot, (SELECT node FROM u WHERE n = 1) AS root, sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x.b || x.a), '')) AS proof_sha256,
  list_reduce(list_concat([{{'b': '', 'a': '', 'c': false_leaf}}], coalesce(path, [])), lambda y, x: {{'b': '', 'a': '', 'c': sha256(x.b || y.c || x.a)}}).c AS folded_root FROM o JOIN s ON s.source IS NOT DISTINCT FROM o.source LEFT JOIN p USING (r))
 SELECT *, folded_root = root AS verified FROM f""",
    "op13_conversation_repair": rf"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
 d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS k FROM o WHERE h <> 0),
 f AS (SELECT *, role[1:1] AS i, rtrim(text, e' \\t\\n\\x0b\\f\\r') AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) > 1 AS again FROM d),
 g AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS b, CASE WHEN v = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN v[-1:] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM f),
 n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (b IS NOT NULL AND b || i NOT IN ('su', 'ua', 'au')) AS illegal,
  string_agg(CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(CASE WHEN i IN ('s', 'u', 'a') THEN i ELSE 'o' END) WHEN i IN ('s', 'u', 'a') THEN i ELSE 'o' END, '' ORDER BY pos) AS turns FROM g GROUP BY 1),
 r AS (SELECT conv_id, length(turns) AS ix, turns, {{'c': 1000000000, 'a': ''}} AS far, {{'c': 0, 'a': ''}} AS v0, {{'c': 10, 'a': 'II'}} AS v1, {{'c': 5, 'a': 'I'}} AS v2, {{'c': 0, 'a': ''}} AS v3 FROM n
  UNION ALL SELECT conv_id, ix, turns, far, list_min([w0, {_edit("5", "I", "w2")}]), list_min([w1, {_edit("5", "I", "w2")}]), w2, w3
  FROM (SELECT conv_id, ix, turns, far, x0 AS w0, x1 AS w1, list_min([x2, {_edit("5", "I", "x3")}]) AS w2, list_min([x3, {_edit("5", "I", "x2")}]) AS w3
  FROM (SELECT conv_id, ix - 1 AS ix, turns, far, {_STEP["v0"]} AS x0, {_STEP["v1"]} AS x1, {_STEP["v2"]} AS x2, {_STEP["v3"]} AS x3
  FROM (SELECT *, turns[ix] AS t, CASE WHEN turns[ix] BETWEEN 'A' AND 'Z' THEN 5 ELSE 0 END AS f FROM r WHERE ix > 0)))),
 z AS (SELECT conv_id, v0.c AS cost, v0.a AS audit, (length(v0.a) - length(replace(v0.a, 'D', ''))) AS gone FROM r WHERE ix = 0),
 e AS (SELECT conv_id, audit, gone, unnest(range(1, length(audit) + 1)) AS j FROM z),
 y AS (SELECT conv_id, j, audit[j] AS x, length(replace(audit[:j], 'I', '')) AS pos, length(replace(audit[:j], 'D', '')) - 1 - (length(audit) - gone) % 2 AS nth FROM e),
 q AS (SELECT y.conv_id, j, CASE WHEN x = 'K' THEN g.role WHEN nth % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE g.text END AS piece FROM y LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM y.conv_id AND g.pos = y.pos WHERE x <> 'D'),
 p AS (SELECT conv_id, sha256(string_agg(piece, chr(10) ORDER BY j)) AS repaired_sha256 FROM q GROUP BY 1)
 SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM i.conv_id""",
}
