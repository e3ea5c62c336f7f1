"""Queries of names and tensors, corpora, records and caches."""

from __future__ import annotations

import json

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftquarry.functions import text
from driftquarry.operators import cache_admin, measure, records
from driftquarry.sources import corpus

from .base import inline, query, r8, table

# --- names -------------------------------------------------------------------

_SPECS = "(VALUES ('wikitext:sub'), ('plain'), ('trailing:'), ('a:b:c'), (':x')) AS t(spec)"


@query("sc2_spec_split", f"SELECT spec, CASE WHEN instr(spec, ':') > 0 AND instr(spec, ':') < length(spec) THEN left(spec, instr(spec, ':') - 1) ELSE spec END AS path, CASE WHEN instr(spec, ':') > 0 AND instr(spec, ':') < length(spec) THEN substr(spec, instr(spec, ':') + 1) END AS subset FROM {_SPECS}")
def sc2(spark, d):
    return inline(spark, _SPECS).select("spec", text.split_spec("spec").alias("s")).select("spec", "s.*")


_PATHS = "(VALUES (1, 'org/Model-27B'), (2, '/data/m/acme__Model-27B-Q4_K_M/x-Q4_K_M.gguf'), (3, '/data/m/acme__Model-4bit'), (4, '/h/models--Org--Name/snapshots/0123456789abcdef0123456789abcdef01234567/'), (5, 'solo'), (6, '/data/Other-q8.GGUF'), (7, '~/m/x'), (8, ''), (9, 'a/b/c/')) AS t(id, p)"
_TRIM = "regexp_replace(p, '/+$', '')"
_TSLUG = f"lower(CASE WHEN regexp_extract({_TRIM}, '(^|/)models--([^/]*)', 2) <> '' THEN replace(regexp_extract({_TRIM}, '(^|/)models--([^/]*)', 2), '--', '__') WHEN contains({_TRIM}, '/') AND {_TRIM}[1] <> '/' THEN array_to_string(string_split({_TRIM}, '/')[-2:], '__') ELSE string_split({_TRIM}, '/')[-1] END)"


@query("pf26_publisher", f"SELECT id, CASE WHEN contains(h, '__') THEN string_split(h, '__')[1] END AS publisher FROM (SELECT id, CASE WHEN lower(p) LIKE '%.gguf' THEN string_split(p, '/')[-2] ELSE string_split(p, '/')[-1] END AS h FROM {_PATHS})")
def pf26(spark, d):
    return inline(spark, _PATHS).select("id", text.publisher("p").alias("publisher"))


@query("pf27_slugs", f"SELECT id, {_TSLUG} AS slug, CASE WHEN {_TRIM} = '' THEN 'unknown' WHEN {_TRIM}[1] IN ('/', '~', '.') THEN {_TSLUG} ELSE {_TRIM} END AS public FROM {_PATHS}")
def pf27(spark, d):
    return inline(spark, _PATHS).select("id", text.teacher_slug("p").alias("slug"), text.public_name("p").alias("public"))


@query("f8_slug", f"SELECT id, regexp_replace(string_split({_TRIM}, '/')[-1], '\\.gguf$', '') AS slug FROM {_PATHS}")
def f8(spark, d):
    return inline(spark, _PATHS).select("id", text.student_slug("p").alias("slug"))


_LABELS = "(VALUES ('Model-27B-Q6_K_L.gguf'), ('org__Model-27B-4bit'), ('Model-27B-MLX-VL-oQ5'), ('Model-27B-oQ4e-mtp'), ('Model-27B-it'), ('acme__Else-8bit'), ('Model-27B')) AS t(name)"


@query("pf28_short_label", f"""WITH a AS (SELECT name, regexp_replace(name, '\\.gguf$', '') AS n FROM {_LABELS}), b AS (SELECT *, instr(lower(n), 'model-27b') AS o FROM a),
c AS (SELECT *, CASE WHEN o > 0 THEN regexp_replace(regexp_replace(trim(substr(n, o + 9), '-_. '), '^((mlx|vl|it|instruct|gguf|mtp)-)+', '', 'i'), '(-(mlx|vl|it|instruct|gguf|mtp))+$', '', 'i') ELSE '' END AS tail FROM b)
SELECT name, regexp_replace(CASE WHEN tail <> '' THEN tail ELSE regexp_replace(n, '^.*?__', '') END, '^(\\d+)bit$', 'q\\1', 'i') AS label FROM c""")
def pf28(spark, d):
    return inline(spark, _LABELS).select("name", text.short_label("name", text.teacher_base(F.lit("org/acme__Model-27B-bf16"))).alias("label"))


_CODECS = "(VALUES ('m1', 'Q4_K', 30), ('m1', 'q6_k', 10), ('m1', 'F32', 99), ('m2', 'iq4_xs', 5), ('m2', 'q8_0', 2), ('m3', 'mxfp4', 7), ('m3', 'bf16', 50), ('m4', 'q5_k', 3), ('m5', 'q8_0', 4), ('m6', 'f16', 4)) AS t(model, codec, n)"
_FAMILY = "CASE WHEN lower(codec) IN ('f32', 'f16', 'bf16') THEN NULL WHEN regexp_matches(lower(codec), '^q[0-9]+_k') THEN 'K-quant' WHEN lower(codec) LIKE 'iq%' THEN 'IQ' WHEN lower(codec) LIKE 'mxfp%' THEN 'MXFP4' ELSE 'GGUF' END"


@query("pf29_codec_family", f"SELECT model, codec, {_FAMILY} AS family FROM {_CODECS}")
def pf29(spark, d):
    return inline(spark, _CODECS).select("model", "codec", text.codec_family("codec").alias("family"))


@query("a24_legend", f"""WITH f AS (SELECT model, {_FAMILY} AS family, sum(n) AS n FROM {_CODECS} GROUP BY ALL), b AS (SELECT model, arg_max(family, n) AS family FROM f WHERE family IS NOT NULL GROUP BY model)
SELECT string_agg(family, ' / ' ORDER BY list_position(['K-quant', 'IQ', 'MXFP4', 'GGUF'], family)) AS legend FROM (SELECT DISTINCT family FROM b)""")
def a24(spark, d):
    per = inline(spark, _CODECS).withColumn("family", text.codec_family("codec")).where("family IS NOT NULL").groupBy("model", "family").agg(F.sum("n").alias("n"))
    main = per.groupBy("model").agg(F.min_by("family", F.struct(-F.col("n"), "family")).alias("family"))
    order = F.array(*[F.lit(f) for f in text.FAMILIES])
    return main.agg(F.collect_set("family").alias("s")).select(F.array_join(F.filter(order, lambda f: F.array_contains("s", f)), " / ").alias("legend"))


@query("a14_codec_hist", f"SELECT model, lower(codec) AS codec, sum(n)::BIGINT AS n FROM {_CODECS} GROUP BY ALL")
def a14(spark, d):
    tensors = inline(spark, _CODECS).select("model", "codec", F.explode(F.sequence(F.lit(1), "n")))
    return measure.codec_histogram(tensors).select("model", "codec", "n")


@query("t4_hist_order", f"SELECT model, lower(codec) AS codec, row_number() OVER (PARTITION BY model ORDER BY n DESC, lower(codec))::INT AS place FROM {_CODECS}")
def t4(spark, d):
    tensors = inline(spark, _CODECS).select("model", "codec", F.explode(F.sequence(F.lit(1), "n")))
    return measure.codec_histogram(tensors).select("model", "codec", "place")


@query("pf32_sha", "SELECT s, regexp_matches(s, '^[0-9a-fA-F]{40}$') AS sha FROM (VALUES ('0123456789abcdef0123456789ABCDEF01234567'), ('0123'), ('main'), ('z123456789abcdef0123456789abcdef01234567')) t(s)")
def pf32(spark, d):
    return inline(spark, "(VALUES ('0123456789abcdef0123456789ABCDEF01234567'), ('0123'), ('main'), ('z123456789abcdef0123456789abcdef01234567')) AS t(s)").select("s", text.is_commit_sha("s").alias("sha"))


@query("f6_xml_escape", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM pages")
def f6(spark, d):
    return table(spark, d, "pages").select("page_id", text.xml_escape("html").alias("x"))


@query("pf10_substring", "SELECT page_id FROM pages WHERE contains(url, 'th.example.')")
def pf10(spark, d):
    return table(spark, d, "pages").where(F.contains("url", F.lit("th.example."))).select("page_id")


# --- tensors -----------------------------------------------------------------

_NAMES = [
    "model.embed_tokens", "lm_head", "model.layers.0.self_attn.q_proj", "model.layers.12.self_attn.k_proj", "model.layers.3.self_attn.v_proj", "model.layers.3.self_attn.o_proj", "visual.blocks.1.attn.qkv",
    "visual.blocks.1.attn.proj", "model.layers.7.linear_attn.in_proj_qkv", "model.layers.7.linear_attn.in_proj_z", "model.layers.7.linear_attn.out_proj", "model.layers.7.linear_attn.conv1d", "model.layers.7.linear_attn.norm",
    "model.layers.7.linear_attn.A_log", "model.layers.1.mlp.gate_proj", "model.layers.1.mlp.up_proj", "model.layers.1.mlp.down_proj", "model.layers.1.mlp.gate_up_proj", "model.layers.1.mlp.experts.switch_mlp.gate_proj",
    "model.layers.1.mlp.experts.down_proj", "model.layers.2.mlp.gate", "model.layers.2.mlp.shared_expert_gate", "model.norm", "model.layers.1.input_layernorm", "visual.merger.mlp.0", "visual.patch_embed.proj",
    "vision_tower.encoder.x", "audio_tower.conv", "embed_vision.proj", "mtp.layers.0.mlp.up_proj", "model.something",
]
_BASES = "(VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ") AS t(base)"
_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(base, '{p}') THEN '{r}'" for r, p in text.ROLES) + " ELSE 'other' END"


@query("pf13_role", f"SELECT base, {_ROLE} AS role FROM {_BASES}")
def pf13(spark, d):
    return inline(spark, _BASES).select("base", text.role("base").alias("role"))


@query("pf14_layer", f"SELECT base, try_cast(nullif(regexp_extract(base, '\\.layers\\.([0-9]+)\\.', 1), '') AS INT) AS layer FROM {_BASES}")
def pf14(spark, d):
    return inline(spark, _BASES).select("base", text.layer_index("base").alias("layer"))


@query("pf15_scored", f"SELECT base, NOT regexp_matches(base, '{text.UNSCORED}') AND NOT ({_ROLE}) LIKE 'vlm.%' AS scored FROM {_BASES}")
def pf15(spark, d):
    return inline(spark, _BASES).select("base", text.is_scored("base").alias("scored"))


_TENSORS = """(VALUES ('m1', 'a.layers.0.mlp.up_proj.weight', 'U32', [8, 8]), ('m1', 'a.layers.0.mlp.up_proj.scales', 'F16', [8, 1]), ('m1', 'a.layers.0.mlp.up_proj.biases', 'F16', [8, 1]), ('m1', 'visual.x.weight', 'F16', [10]),
('m1', 'a.norm.weight', 'BF16', [64]), ('m2', 'b.w.weight', 'F32', [4, 4]), ('m2', 'b.scalar', 'F32', []), ('m2', 'b.odd.weight', 'Q9', [3, 3]), ('m3', 'c.x.weight', 'U32', [4, 2, 8]), ('m3', 'c.x.scales', 'F32', [4, 2, 2])) AS t(model, name, dtype, shape)"""
_CONFIG = "(VALUES ('m1', 64, 4), ('m2', NULL, NULL), ('m3', 32, 4)) AS t(model, default_group, default_bits)"
_OWN = "(VALUES ('m3', 'c.x', 128)) AS t(model, base, own_group)"
_WIDTHS = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in measure.WIDTHS.items()) + ") AS w(dtype, width)"
_PROD = "coalesce(list_product(shape), 1)::BIGINT"
_SIZED = f"tz AS (SELECT t.*, {_PROD} * coalesce(width, 0) AS nbytes, {_PROD} AS n FROM {_TENSORS} LEFT JOIN {_WIDTHS} USING (dtype))"
_MODULES = f"""{_SIZED}, tk AS (SELECT *, regexp_extract(name, '\\.(weight|scales|biases)$', 1) AS kind, regexp_replace(name, '\\.(weight|scales|biases)$', '') AS base FROM tz),
mods AS (SELECT model, base, max(shape) FILTER (WHERE kind IN ('weight', '')) AS ws, max(dtype) FILTER (WHERE kind IN ('weight', '')) AS wd, max(shape) FILTER (WHERE kind = 'scales') AS ss, sum(nbytes)::BIGINT AS total_bytes FROM tk GROUP BY ALL),
par AS (SELECT m.*, default_bits, CASE WHEN ss IS NOT NULL THEN coalesce(list_product(ws[:-2]), 1)::BIGINT * ss[-1] * coalesce(nullif(own_group, 0), nullif(default_group, 0), 64) ELSE coalesce(list_product(ws), 1)::BIGINT END AS n_params,
  NOT regexp_matches(base, '{text.UNSCORED}') AND NOT ({_ROLE}) LIKE 'vlm.%' AS scored FROM mods m LEFT JOIN {_CONFIG.replace('AS t(', 'AS c(')} USING (model) LEFT JOIN {_OWN.replace('AS t(', 'AS o(')} USING (model, base))"""


def _tensors(spark):
    rows = _TENSORS.replace("[]", "array()").replace("[", "array(").replace("])", "))").replace("]", ")")
    return inline(spark, rows.replace("array(()", "array()")).withColumn("shape", F.col("shape").cast("array<bigint>"))


def _modules(spark):
    return measure.modules(measure.with_bytes(_tensors(spark)))


def _measured(spark):
    mods = _modules(spark).join(F.broadcast(inline(spark, _CONFIG)), "model", "left").join(F.broadcast(inline(spark, _OWN)), ["model", "base"], "left")
    return measure.affine_parameters(mods)


@query("k16_nbytes", f"WITH {_SIZED} SELECT model, name, nbytes FROM tz")
def k16(spark, d):
    return measure.with_bytes(_tensors(spark)).select("model", "name", "nbytes")


@query("j10_dtype_width", f"SELECT model, name, coalesce(width, 0) AS width FROM {_TENSORS} LEFT JOIN {_WIDTHS} USING (dtype)")
def j10(spark, d):
    sized = measure.with_bytes(_tensors(spark))
    return sized.select("model", "name", F.expr("nbytes div aggregate(shape, 1L, (a, x) -> a * x)").cast("int").alias("width"))


@query("j5_module_pivot", f"WITH {_MODULES} SELECT model, base, wd AS weight_dtype, ss IS NOT NULL AS quantized, total_bytes FROM mods")
def j5(spark, d):
    return _modules(spark).select("model", "base", "weight_dtype", F.col("scales_shape").isNotNull().alias("quantized"), "total_bytes")


@query("j6_override", f"WITH {_MODULES} SELECT model, base, n_params FROM par")
def j6(spark, d):
    return _measured(spark).select("model", "base", "n_params")


@query("k17_affine_params", f"WITH {_MODULES} SELECT model, base, n_params, scored FROM par")
def k17(spark, d):
    return _measured(spark).select("model", "base", "n_params", "scored")


@query("k19_bpw", f"WITH {_MODULES} SELECT model, base, round(total_bytes * 8.0 / nullif(n_params, 0), 8) AS bpw FROM par")
def k19(spark, d):
    return _measured(spark).select("model", "base", r8(F.col("total_bytes") * 8.0 / F.nullif("n_params", F.lit(0))).alias("bpw"))


@query("a16_model_totals", f"""WITH {_MODULES} SELECT model, sum(total_bytes)::BIGINT AS size_bytes, sum(n_params)::BIGINT AS n_params, round(sum(total_bytes) * 8.0 / nullif(sum(n_params), 0), 8) AS effective_bpw,
coalesce(sum(total_bytes) FILTER (WHERE scored), 0)::BIGINT AS scored_bytes, coalesce(sum(n_params) FILTER (WHERE scored), 0)::BIGINT AS scored_n_params, CASE WHEN bool_or(ss IS NOT NULL OR default_bits IS NOT NULL) THEN 'mlx-affine' ELSE 'mlx' END AS format FROM par GROUP BY model""")
def a16(spark, d):
    return measure.totals(_measured(spark)).select("model", "size_bytes", "n_params", r8("effective_bpw").alias("effective_bpw"), "scored_bytes", "scored_n_params", "format")


@query("a15_dominant_dtype", f"WITH {_SIZED}, b AS (SELECT model, dtype, sum(nbytes) AS b FROM tz GROUP BY ALL) SELECT model, dtype FROM b QUALIFY row_number() OVER (PARTITION BY model ORDER BY b DESC, dtype) = 1")
def a15(spark, d):
    return measure.dominant_dtype(measure.with_bytes(_tensors(spark))).select("model", "dtype")


_GGUF = "(VALUES ('g', 'blk.0.attn_q.weight', 800, [1000]), ('g', 'blk.64.attn_q.weight', 32, [24]), ('g', 'blk.64.nextn.eh_proj.weight', 8, [1]), ('g', 'v.patch.weight', 4, [2]), ('g', 'mm.0.weight', 4, [2]), ('h', 'blk.1.ffn_up.weight', 90, [10, 9]), ('h', 'token_embd.weight', 10, [20])) AS t(model, name, nbytes, shape)"
_DROP = f"mtp AS (SELECT DISTINCT model, try_cast(nullif(regexp_extract(name, '^blk[.]([0-9]+)[.]', 1), '') AS INT) AS block FROM {_GGUF} WHERE contains(name, '.nextn.')), gs AS (SELECT t.* FROM {_GGUF} WHERE NOT starts_with(name, 'v.') AND NOT starts_with(name, 'mm.') AND NOT EXISTS (SELECT 1 FROM mtp WHERE mtp.model = t.model AND mtp.block = try_cast(nullif(regexp_extract(t.name, '^blk[.]([0-9]+)[.]', 1), '') AS INT)))"


def _gguf(spark):
    return inline(spark, _GGUF.replace("[", "array(").replace("])", "))")).withColumn("shape", F.col("shape").cast("array<bigint>"))


@query("pf16_gguf_scored", f"WITH {_DROP} SELECT model, name FROM gs")
def pf16(spark, d):
    return measure.gguf_scored(_gguf(spark)).select("model", "name")


@query("j8_mtp_anti", f"WITH {_DROP} SELECT model, count(*) AS n FROM gs GROUP BY model")
def j8(spark, d):
    return measure.gguf_scored(_gguf(spark)).groupBy("model").agg(F.count("*").alias("n"))


@query("u5_mtp_blocks", f"WITH {_DROP} SELECT model, block FROM mtp")
def u5(spark, d):
    return measure.draft_blocks(_gguf(spark))


@query("u3_unscored_except", f"WITH {_DROP} SELECT model, name FROM {_GGUF} EXCEPT SELECT model, name FROM gs")
def u3(spark, d):
    t = _gguf(spark)
    return t.select("model", "name").exceptAll(measure.gguf_scored(t).select("model", "name"))


_DECLARED = "(VALUES ('g', 1024), ('h', 100)) AS n(model, n_params)"


@query("a17_gguf_totals", f"""WITH {_DROP}, u AS (SELECT t.model, coalesce(sum(CASE WHEN gs.name IS NULL THEN {_PROD.replace('shape', 't.shape')} END), 0)::BIGINT AS un, sum(t.nbytes)::BIGINT AS size_bytes, coalesce(sum(gs.nbytes), 0)::BIGINT AS scored_bytes FROM {_GGUF} LEFT JOIN gs USING (model, name) GROUP BY t.model)
SELECT model, size_bytes, scored_bytes, greatest(n_params - un, 0)::BIGINT AS scored_n_params, round(size_bytes * 8.0 / n_params, 8) AS effective_bpw FROM u JOIN {_DECLARED} USING (model)""")
def a17(spark, d):
    out = measure.gguf_totals(_gguf(spark), inline(spark, _DECLARED).withColumn("n_params", F.col("n_params").cast("bigint")))
    return out.select("model", "size_bytes", "scored_bytes", "scored_n_params", r8("effective_bpw").alias("effective_bpw"))


_KQ = "(VALUES ('m', 'a', 1440, [100, 256]), ('m', 'b', 4096, [32, 64]), ('m', 'c', 999, [7])) AS t(model, base, nbytes, shape)"
_KMAP = "(VALUES ('m', 'a', 'q4_k'), ('m', 'b', 'none'), ('m', 'z', 'q6_k')) AS c(model, base, codec)"
_KGEO = "(VALUES ('q4_k', 144, 256), ('q6_k', 210, 256)) AS g(codec, bytes_per_block, weights_per_block)"


def _codecs(spark):
    t = inline(spark, _KQ.replace("[", "array(").replace("])", "))")).withColumn("shape", F.col("shape").cast("array<bigint>"))
    return measure.codec_parameters(t, inline(spark, _KMAP), inline(spark, _KGEO))


@query("k18_kquant_params", f"SELECT base, CASE WHEN bytes_per_block > 0 THEN nbytes // bytes_per_block * weights_per_block ELSE {_PROD} END::BIGINT AS n_params FROM {_KQ} LEFT JOIN {_KMAP} USING (model, base) LEFT JOIN {_KGEO} USING (codec)")
def k18(spark, d):
    return _codecs(spark).select("base", F.col("n_params").cast("bigint").alias("n_params"))


@query("j7_codec_geometry", f"SELECT base, codec, bytes_per_block FROM {_KQ} LEFT JOIN {_KMAP} USING (model, base) LEFT JOIN {_KGEO} USING (codec)")
def j7(spark, d):
    return _codecs(spark).select("base", "codec", "bytes_per_block")


_CFG = """(VALUES (1, '{"quantization": {"mode": "kquant"}}'), (2, '{"quantization_config": {"mode": "kquant"}}'), (3, '{"quantization": {"bits": 4}}'), (4, '{}')) AS t(id, config)"""


@query("pf30_kquant_detect", f"SELECT id, coalesce(coalesce(json_extract_string(config, '$.quantization_config.mode'), json_extract_string(config, '$.quantization.mode')) = 'kquant', false) AS kquant FROM {_CFG}")
def pf30(spark, d):
    mode = F.coalesce(F.get_json_object("config", "$.quantization_config.mode"), F.get_json_object("config", "$.quantization.mode"))
    return inline(spark, _CFG).select("id", F.coalesce(mode == "kquant", F.lit(False)).alias("kquant"))


# --- corpora -----------------------------------------------------------------


@query("sc1_corpus_scan", "SELECT doc_id AS row_idx, text FROM documents WHERE regexp_matches(text, '\\S')")
def sc1(spark, d):
    return corpus.corpus_texts(corpus.read_corpus(spark, f"{d}/documents.parquet"), "doc_id")


_BLANK = "(VALUES (1, 'a'), (2, '   '), (3, ''), (4, 'b'), (5, chr(10) || chr(9)), (6, chr(160)), (7, NULL)) AS t(id, s)"


@query("pf1_nonblank", f"SELECT id FROM {_BLANK} WHERE regexp_matches(replace(s, chr(160), ' '), '\\S')")
def pf1(spark, d):
    return inline(spark, _BLANK).where(text.nonblank("s")).select("id")


def _chats(spark, d):
    turns = table(spark, d, "conversations")
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def _template(role, content):
    return F.concat(F.lit("<"), role, F.lit(">"), content, F.lit("\n"))


@query("f10_chat_render", "SELECT conv_id, string_agg('<' || role || '>' || text || chr(10), '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def f10(spark, d):
    return _chats(spark, d).select("conv_id", corpus.render_chat("messages", _template).alias("rendered"))


@query("pf2_chat_nonblank", "SELECT conv_id AS row_idx, length(string_agg('<' || role || '>' || text || chr(10), '' ORDER BY turn))::INT AS n FROM conversations GROUP BY conv_id")
def pf2(spark, d):
    return corpus.corpus_texts(_chats(spark, d), "conv_id", _template).select("row_idx", F.length("text").alias("n"))


_WORDS = "SELECT doc_id AS row_idx, regexp_extract_all(lower(text), '[a-z]+') AS tokens FROM documents"


@query("f11_tokenize", f"SELECT row_idx, len(tokens)::INT AS n, array_to_string(tokens, ' ') AS tokens FROM ({_WORDS})")
def f11(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), corpus.words("text").alias("t")).select("row_idx", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


def _ordered(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), "text")


def _counted(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), corpus.words("text").alias("tokens")).withColumn("n", F.size("tokens"))


_RUN = f"r AS (SELECT *, len(tokens) AS n, coalesce(sum(len(tokens)) OVER (ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM ({_WORDS}))"


@query("w1_head_window", f"WITH {_RUN} SELECT row_idx, n::INT AS n, before FROM r WHERE before < 2176")
def w1(spark, d):
    return corpus.head_rows(_ordered(spark, d), corpus.words, 2176).select("row_idx", "n", "before")


@query("t6_head_limit", f"WITH {_RUN} SELECT count(*) AS used, sum(n)::BIGINT AS tokens FROM r WHERE before < 40000")
def t6(spark, d):
    return corpus.head_rows(_ordered(spark, d), corpus.words, 40000).agg(F.count("*").alias("used"), F.sum("n").alias("tokens"))


@query("w2_chunks", f"WITH {_RUN}, p AS (SELECT before + i AS g, token FROM (SELECT before, unnest(range(0, len(tokens))) AS i, unnest(tokens) AS token FROM r)) SELECT g // 64 AS chunk, string_agg(token, ' ' ORDER BY g) AS tokens FROM p GROUP BY chunk HAVING count(*) = 64")
def w2(spark, d):
    return corpus.chunks(corpus.with_offsets(_counted(spark, d), "n"), 64).select("chunk", F.array_join("tokens", " ").alias("tokens"))


def _sample_sql(tokens: str, last: str) -> str:
    """The sample of 16 chunks of 64: the seeded permutations are given for every number of chunks that a head can have."""
    orders = ", ".join(f"({n}, {i}, {c})" for n in range(33, 700) for i, c in enumerate(corpus.sample_order(n, 16, 123)))
    return f"""WITH t AS (SELECT doc_id, {tokens} AS t FROM documents WHERE regexp_matches(text, '\\S')),
o AS (SELECT *, coalesce(sum(len(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
h AS (SELECT * FROM o WHERE before < 2176),
f AS (SELECT before + unnest(range(0, len(t))) AS place, unnest(t) AS x FROM h),
c AS (SELECT (place // 64)::BIGINT AS chunk, list(x ORDER BY place) AS x FROM f GROUP BY ALL),
p AS (SELECT seq_id, chunk FROM (VALUES {orders}) v(n, seq_id, chunk) WHERE n = (SELECT count(*) // 64 FROM f)),
s AS (SELECT p.seq_id::INT AS seq_id, x FROM p JOIN c USING (chunk))
{last}"""


@query("j9_seeded_sample", _sample_sql("regexp_extract_all(lower(text), '[a-z]+')", "SELECT seq_id, array_to_string(x, ' ') AS tokens FROM s"))
def j9(spark, d):
    rows = corpus.corpus_texts(table(spark, d, "documents"), "doc_id")
    return corpus.calibration_chunks(rows, corpus.words, 16, 64, 123).select("seq_id", F.array_join("tokens", " ").alias("tokens"))


@query(
    "f14_stream_hash",
    _sample_sql("list_transform(string_split(text, ''), lambda c: unicode(c) % 4096)", "SELECT left(sha256(unhex(string_agg(printf('%02x%02x0000', v % 256, v // 256), '' ORDER BY seq_id, i))), 16) AS stream_hash FROM (SELECT seq_id, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM s)"),
)
def f14(spark, d):
    rows = corpus.corpus_texts(table(spark, d, "documents"), "doc_id")
    return spark.createDataFrame([(corpus.stream_hash(corpus.calibration_chunks(rows, corpus.code_points, 16, 64, 123)),)], "stream_hash string")


_VOCAB = "(VALUES ('t', 0, 'a'), ('t', 1, 'b'), ('t', 2, 'c'), ('s', 0, 'a'), ('s', 1, 'x'), ('s', 3, 'd')) AS t(tokenizer, id, token)"


@query("j11_vocab_diff", f"SELECT id, t.token AS teacher, s.token AS student FROM (SELECT * FROM {_VOCAB} WHERE tokenizer = 't') t FULL JOIN (SELECT * FROM {_VOCAB} WHERE tokenizer = 's') s USING (id) WHERE t.token IS DISTINCT FROM s.token")
def j11(spark, d):
    v = inline(spark, _VOCAB)
    t, s = (v.where(F.col("tokenizer") == x).select("id", F.col("token").alias(n)) for x, n in (("t", "teacher"), ("s", "student")))
    return t.join(s, "id", "full").where(~F.col("teacher").eqNullSafe(F.col("student"))).select("id", "teacher", "student")


@query("f15_vocab_hash", f"SELECT tokenizer, sha256('vocab_size=' || count(*) || chr(10) || string_agg(id || chr(9) || token || chr(10), '' ORDER BY id) || 'bos_token_id=1' || chr(10) || 'eos_token_id=2' || chr(10) || 'pad_token_id=None' || chr(10) || 'unk_token_id=0' || chr(10)) AS hash FROM {_VOCAB} GROUP BY tokenizer")
def f15(spark, d):
    special = {"bos_token_id": F.lit(1), "eos_token_id": F.lit(2), "pad_token_id": F.lit(None).cast("int"), "unk_token_id": F.lit(0)}
    g = inline(spark, _VOCAB).groupBy("tokenizer").agg(F.collect_list(F.struct("id", "token")).alias("e"))
    return g.select("tokenizer", text.vocabulary_hash(F.col("e"), F.size("e"), special).alias("hash"))


@query("j12_parity", "WITH p AS (SELECT item_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS a, list_transform(string_split(text, ' '), lambda x: CASE WHEN length(x) > 14 THEN 14 ELSE length(x) END) AS b FROM benchmark) SELECT count(*) AS probes, count(*) FILTER (WHERE a <> b) AS different, min(item_id) FILTER (WHERE a <> b) AS first_different FROM p")
def j12(spark, d):
    probes = table(spark, d, "benchmark").withColumn("w", F.split("text", " "))
    teacher = probes.select("item_id", F.transform("w", F.length).alias("a"))
    student = probes.select("item_id", F.transform("w", lambda x: F.least(F.length(x), F.lit(14))).alias("b"))
    both = teacher.join(student, "item_id").withColumn("differs", F.col("a") != F.col("b"))
    return both.agg(F.count("*").alias("probes"), F.count_if("differs").alias("different"), F.min(F.when(F.col("differs"), F.col("item_id"))).alias("first_different"))


_STREAM = "(VALUES (1, NULL, 'x'), (2, 'x', 'x'), (3, 'x', 'y')) AS t(id, cached, student)"


@query("pf23_stream_status", f"SELECT id, CASE WHEN cached IS NOT NULL THEN cached = student END AS same FROM {_STREAM}")
def pf23(spark, d):
    return inline(spark, _STREAM).select("id", F.when(F.col("cached").isNotNull(), F.col("cached") == F.col("student")).alias("same"))


# --- records -----------------------------------------------------------------

_RUNS = """(VALUES
(1, 'T1', '/m/acme__S-4bit', 'c', 512, 512, 123, 32768, [256, 512], 'mlx-student', 'h1', 'affine', 15.0, 4.5, 0.02, 0.001, 0.96, 100, 'mlx-affine'),
(2, 'T1', '/m/beta__S/S-Q4_K_M.gguf', 'c', 512, 512, 123, 32768, [256, 512], 'hf-source', 'h1', 'gguf', 16.5, 4.8, 0.01, 0.006, 0.97, 100, 'gguf'),
(3, 'T1', '/m/acme__S-4bit', 'c', 512, 512, 123, 32768, [256, 512], 'mlx-student', 'h1', 'affine', 15.0, 4.5, 0.09, 0.001, 0.91, 100, 'mlx-affine'),
(4, 'T1', '/m/gamma__S/S-Q4_K_M.gguf', 'c', 512, 512, 123, 32768, [256, 512], 'hf-source', NULL, 'gguf', 17.5, 4.9, NULL, NULL, NULL, 0, 'gguf'),
(5, 'T1', '/m/gamma__S/S-Q4_K_M.gguf', 'c', 512, 512, 123, 32768, NULL, 'mlx-student', NULL, 'none', 0.0, 16.0, 0.0, NULL, 1.0, 100, 'mlx'),
(6, 'T2', '/m/acme__S-8bit', 'c', 128, 512, 777, 8192, [256, 512], NULL, NULL, NULL, 27.0, 8.5, 0.005, 0.004, 0.99, 50, 'mlx-affine'),
(7, 'T2', '/m/acme__S-3bit', 'c', 128, 512, 777, 8192, [256, 512], '', NULL, 'affine', 11.0, 3.5, 1.5, 0.004, 0.4, 50, 'mlx-affine'),
(8, 'T2', '/m/delta__S-3bit', 'c', 128, 512, 777, 8192, [256, 512], '', '', 'affine', 11.5, 3.6, 0.005, 0.004, 0.95, 50, 'mlx-affine'))
AS t(load_order, teacher, student, corpus, num_samples, max_seq_len, seed, top_k, win, tok_mode, tokh, kind, gb, bpw, mean, floor_mean, top1, tokens_scored, format)"""
_RUNSQL = f"""runs AS (SELECT *, nullif(tokh, '') AS tokens_hash, CASE WHEN nullif(tokh, '') IS NULL THEN tok_mode END AS mode FROM {_RUNS})"""
_KEYS = "corpus, num_samples, max_seq_len, seed, top_k, win, mode, tokens_hash"


def _runs(spark):
    raw = inline(spark, _RUNS.replace("[", "array(").replace("]", ")"))
    raw = raw.withColumn("window", F.col("win").cast("array<int>")).withColumn("tokens_hash", F.nullif("tokh", F.lit("")))
    numbers = [F.col(c).cast("double").alias(c) for c in ("gb", "bpw", "mean", "floor_mean", "top1")]
    kept = [c for c in raw.columns if c not in ("gb", "bpw", "mean", "floor_mean", "top1", "win", "tokh")]
    return raw.select(*kept, *numbers).withColumn("mode", F.when(F.col("tokens_hash").isNull(), F.col("tok_mode")))


def _spec_text(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'None' ELSE " + (f"'(' || array_to_string({c}, ', ') || ')'" if c == "win" else f"{c}::VARCHAR") + " END"


_ORDER = ", ".join(_spec_text(c.strip()) for c in _KEYS.split(","))
_RANKED = f"""{_RUNSQL}, sp AS (SELECT *, dense_rank() OVER (PARTITION BY teacher ORDER BY {_ORDER})::INT AS spec FROM runs),
rk AS (SELECT *, row_number() OVER (PARTITION BY teacher, spec ORDER BY coalesce(mean, 'Infinity'::DOUBLE), load_order)::INT AS place FROM sp)"""


@query("w7_dedup", f"WITH {_RUNSQL} SELECT load_order FROM runs QUALIFY row_number() OVER (PARTITION BY student, teacher, {_KEYS} ORDER BY load_order) = 1")
def w7(spark, d):
    return records.first_of_each(_runs(spark), ["student", "teacher", *records.PROTOCOL]).select("load_order")


@query("u1_path_union", "SELECT min(o_custkey) AS o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY o_custkey")
def u1(spark, d):
    o = table(spark, d, "orders")
    a, b = o.where("o_orderstatus = 'F'").select("o_custkey", F.lit(0).alias("i")), o.where("o_orderpriority LIKE '1%'").select("o_custkey", F.lit(1).alias("i"))
    return records.first_of_each(a.unionByName(b), ["o_custkey"], "i").select("o_custkey")


@query("w8_spec_rank", f"WITH {_RANKED} SELECT load_order, spec FROM rk")
def w8(spark, d):
    return records.rank_records(_runs(spark)).select("load_order", "spec")


@query("t1_rank", f"WITH {_RANKED} SELECT load_order, place, coalesce(floor_mean > 0 AND mean < 2 * floor_mean, false) AS floor_limited FROM rk")
def t1(spark, d):
    return records.rank_records(_runs(spark)).select("load_order", "place", "floor_limited")


@query("a18_by_teacher", f"WITH {_RUNSQL} SELECT teacher, count(*) AS n, min(load_order) AS first FROM runs GROUP BY teacher")
def a18(spark, d):
    return _runs(spark).groupBy("teacher").agg(F.count("*").alias("n"), F.min("load_order").alias("first"))


@query("a19_spec_groups", f"WITH {_RUNSQL} SELECT teacher, num_samples, top_k, array_to_string(win, ':') AS win, mode, tokens_hash, count(*) AS n FROM runs GROUP BY teacher, {_KEYS}")
def a19(spark, d):
    g = _runs(spark).groupBy("teacher", *records.PROTOCOL).agg(F.count("*").alias("n"))
    return g.select("teacher", "num_samples", "top_k", F.when(F.col("window").isNotNull(), F.concat_ws(":", F.col("window").cast("array<string>"))).alias("win"), "mode", "tokens_hash", "n")


@query("a20_modes", f"WITH {_RUNSQL} SELECT teacher, string_agg(m, ', ' ORDER BY m) AS modes FROM (SELECT DISTINCT teacher, coalesce(nullif(tok_mode, ''), 'n/a') AS m FROM runs) GROUP BY teacher")
def a20(spark, d):
    return _runs(spark).groupBy("teacher").agg(records.tokenizer_modes("tok_mode").alias("modes"))


@query("a21_distinct_specs", f"WITH {_RUNSQL} SELECT teacher, count(*) AS specs FROM (SELECT DISTINCT teacher, {_KEYS} FROM runs) GROUP BY teacher")
def a21(spark, d):
    return _runs(spark).groupBy("teacher").agg(F.count_distinct(F.struct(*records.PROTOCOL)).alias("specs"))


@query("pf11_quantized", f"WITH {_RUNSQL} SELECT load_order FROM runs WHERE kind IS DISTINCT FROM 'none'")
def pf11(spark, d):
    return _runs(spark).where(~F.col("kind").eqNullSafe(F.lit("none"))).select("load_order")


@query("pf12_plottable", f"WITH {_RUNSQL} SELECT load_order FROM runs WHERE nullif(gb, 0) IS NOT NULL AND mean > 0")
def pf12(spark, d):
    return _runs(spark).where(F.nullif("gb", F.lit(0.0)).isNotNull() & (F.col("mean") > 0)).select("load_order")


@query("a23_collisions", f"""WITH {_RUNSQL}, l AS (SELECT load_order, format, regexp_replace(string_split(student, '/')[-1], '^.*?__|\\.gguf$', '', 'g') AS label, CASE WHEN student LIKE '%.gguf' THEN string_split(string_split(student, '/')[-2], '__')[1] ELSE string_split(string_split(student, '/')[-1], '__')[1] END AS publisher FROM runs)
SELECT load_order, label, publisher, count(*) OVER (PARTITION BY label) > 1 AS collides FROM l""")
def a23(spark, d):
    label = F.regexp_replace(text.student_slug("student"), "^.*?__", "")
    return _runs(spark).select("load_order", label.alias("label"), text.publisher("student").alias("publisher"), (F.count("*").over(W.partitionBy(label)) > 1).alias("collides"))


@query("a25_extents", f"WITH {_RUNSQL} SELECT teacher, round(min(mean)::DOUBLE, 8) AS low, round(max(mean)::DOUBLE, 8) AS high, max(mean) / min(mean) > 25 AS wide FROM runs WHERE mean > 0 GROUP BY teacher")
def a25(spark, d):
    g = _runs(spark).where("mean > 0").groupBy("teacher")
    return g.agg(r8(F.min("mean")).alias("low"), r8(F.max("mean")).alias("high"), (F.max("mean") / F.min("mean") > 25).alias("wide"))


@query("a26_first_floor", f"WITH {_RUNSQL} SELECT teacher, arg_min(floor_mean, load_order)::DOUBLE AS floor FROM runs WHERE floor_mean > 0 GROUP BY teacher")
def a26(spark, d):
    return _runs(spark).where("floor_mean > 0").groupBy("teacher").agg(F.min_by("floor_mean", "load_order").alias("floor"))


@query("t5_xy_order", f"WITH {_RUNSQL} SELECT load_order, row_number() OVER (ORDER BY gb, mean, load_order)::INT AS place FROM runs WHERE gb > 0 AND mean > 0")
def t5(spark, d):
    return _runs(spark).where("gb > 0 AND mean > 0").select("load_order", F.row_number().over(W.orderBy("gb", "mean", "load_order")).alias("place"))


@query("t9_teachers", f"WITH {_RUNSQL} SELECT string_agg(teacher, ', ' ORDER BY teacher) AS teachers FROM (SELECT DISTINCT teacher FROM runs)")
def t9(spark, d):
    return _runs(spark).agg(F.array_join(F.array_sort(F.collect_set("teacher")), ", ").alias("teachers"))


@query("f5_window", f"WITH {_RUNSQL} SELECT load_order, CASE WHEN win IS NULL THEN 'n/a' ELSE win[1] || ':' || win[2] END AS label FROM runs")
def f5(spark, d):
    return _runs(spark).select("load_order", text.window_label("window").alias("label"))


@query("f12_digest", f"WITH {_RUNSQL} SELECT load_order, left(sha256(concat_ws('|', corpus, num_samples, max_seq_len, seed, top_k, CASE WHEN win IS NULL THEN 'None' ELSE '[' || array_to_string(win, ', ') || ']' END, coalesce(tok_mode, 'None'), teacher)), 8) AS digest FROM runs")
def f12(spark, d):
    return _runs(spark).select("load_order", text.run_digest("corpus", "num_samples", "max_seq_len", "seed", "top_k", "window", "tok_mode", "teacher").alias("digest"))


@query("f13_cache_key", f"WITH {_RUNSQL} SELECT load_order, left(sha256(concat_ws('|', teacher, corpus, num_samples, max_seq_len, seed, top_k, 'v1')), 16) AS key FROM runs")
def f13(spark, d):
    return _runs(spark).select("load_order", text.cache_key("teacher", "corpus", "num_samples", "max_seq_len", "seed", "top_k").alias("key"))


def _record(**change) -> dict:
    out = {
        "schema_version": 1, "teacher": {"path": "T"}, "student": {"path": "S", "format": "gguf", "size_bytes": 1, "effective_bpw": 4.5, "n_params": 2, "quantization": {"kind": "gguf"}}, "tokenizer": {"mode": "m", "identical": True, "encoding_parity": True, "forced": False, "diffs": []},
        "calibration": {"corpus": "c", "num_samples": 1, "max_seq_len": 2, "seed": 3}, "kld": dict.fromkeys(records.WITHIN["kld"], 0.1) | {"mean": None}, "delta_p": dict.fromkeys(("mean", "se", "rms")), "agreement": {"top1": 1.0, "top5": 1.0}, "tokens_scored": 5, "elapsed_seconds": 1.5, "scorer_version": "1", "timestamp": "t",
    }
    for path, value in change.items():
        at, *rest = path.split("__")
        where = out
        for key in rest:
            where, at = where[at], key
        if value is KeyError:
            del where[at]
        else:
            where[at] = value
    return out


_RECORDS: list[tuple[int, str, str | None]] = [
    (1, json.dumps(_record()), None),
    (2, json.dumps(_record(kld=KeyError)), "missing key kld"),
    (3, json.dumps(_record(schema_version=2)), "schema_version is not 1"),
    (4, json.dumps(_record(student__format="zip")), "student.format unknown"),
    (5, json.dumps(_record(student__quantization={})), "student.quantization needs a kind"),
    (6, json.dumps(_record(kld__p999=KeyError)), "kld.p999 missing"),
    (7, "[1, 2, 3]", "not an object"),
    (8, "42", "not an object"),
    (9, '"word"', "not an object"),
    (10, json.dumps(_record(teacher="T")), "teacher is not object"),
    (11, json.dumps(_record(agreement__top5=KeyError)), "agreement.top5 missing"),
    (12, json.dumps(_record(calibration__score_window=5)), None),
    (13, json.dumps(_record(kld_histogram={"bin_edges": [0, float("inf")]})), None),
    (14, json.dumps(_record(student__n_params=KeyError)), "student.n_params missing"),
    (15, json.dumps(_record(tokens_scored="many")), "tokens_scored is not int"),
    (16, "{broken", "not JSON"),
]


def _quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


@query("pf9_reject_reason", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quoted(r)})" for i, _, r in _RECORDS) + ") t(id, reason)")
def pf9(spark, d):
    return spark.createDataFrame([r[:2] for r in _RECORDS], "id int, value string").select("id", records.reject_reason().alias("reason"))


@query("u4_missing_keys", "SELECT * FROM (VALUES (1, ''), (2, 'kld'), (3, ''), (7, '" + ",".join(sorted(records.TOP)) + "')) t(id, missing)")
def u4(spark, d):
    return spark.createDataFrame([r[:2] for r in _RECORDS if r[0] in (1, 2, 3, 7)], "id int, value string").select("id", F.array_join(records.missing_keys(), ",").alias("missing"))


# --- caches ------------------------------------------------------------------

_NOW = "2026-01-01 00:00:00"
_ENTRIES_SQL = "e AS (SELECT 'u' || user_id AS key, (sum(value) * 1000)::BIGINT AS size_bytes, max(ts) AS last_used, user_id % 11 = 0 AS locked FROM events GROUP BY user_id)"


def _entries(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("v"), F.max("ts").cast("timestamp").alias("last_used"))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.round(F.col("v") * 1000).cast("bigint").alias("size_bytes"), "last_used", (F.col("user_id") % 11 == 0).alias("locked"))


def _half(entries):
    return int((entries.agg(F.sum("size_bytes")).first()[0] or 0) // 2)


_LRU = """b AS (SELECT sum(size_bytes)::BIGINT AS total, (sum(size_bytes) // 2)::BIGINT AS budget FROM {src}),
m AS (SELECT *, coalesce(sum(size_bytes) OVER (PARTITION BY free ORDER BY last_used, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, NOT locked AND key NOT IN ('u1', 'u2') AS free FROM {src})),
l AS (SELECT key, free AND total - before > budget AS evict FROM m, b)"""


@query("w9_lru", f"WITH {_ENTRIES_SQL}, {_LRU.format(src='e')} SELECT key, evict FROM l")
def w9(spark, d):
    e = _entries(spark, d)
    return cache_admin.plan_eviction(e, _half(e), ("u1", "u2")).select("key", "evict")


@query("c6_gc", f"WITH {_ENTRIES_SQL}, cut AS (SELECT quantile_disc(last_used, 0.3) AS c FROM e), a AS (SELECT e.*, NOT locked AND last_used < c AS aged FROM e, cut), r AS (SELECT * FROM a WHERE NOT aged), {_LRU.format(src='r').replace(chr(39) + 'u1' + chr(39) + ', ' + chr(39) + 'u2' + chr(39), chr(39) + chr(39))} SELECT key, 'age' AS reason FROM a WHERE aged UNION ALL SELECT key, CASE WHEN evict THEN 'budget' END FROM l")
def c6(spark, d):
    e = _entries(spark, d)
    cut = e.select(F.element_at(F.array_sort(F.collect_list("last_used").over(W.partitionBy())), F.greatest(F.lit(1), F.ceil(F.count("*").over(W.partitionBy()) * 0.3).cast("int"))).alias("c")).first()[0]
    budget = _half(e.where(F.col("locked") | (F.col("last_used") >= F.lit(cut))))
    return cache_admin.collect_garbage(e, budget, F.lit(cut)).select("key", "reason")


@query("c7_clear", f"WITH {_ENTRIES_SQL} SELECT key FROM e WHERE contains(key, '1') AND NOT locked")
def c7(spark, d):
    return _entries(spark, d).where(F.contains("key", F.lit("1")) & ~F.col("locked")).select("key")


@query("a22_cache_totals", f"WITH {_ENTRIES_SQL} SELECT count(*) AS entries, sum(size_bytes)::BIGINT AS size_bytes FROM e")
def a22(spark, d):
    return _entries(spark, d).agg(F.count("*").alias("entries"), F.sum("size_bytes").alias("size_bytes"))


@query("t3_newest", f"WITH {_ENTRIES_SQL} SELECT key, row_number() OVER (ORDER BY last_used DESC, key)::INT AS place FROM e")
def t3(spark, d):
    return _entries(spark, d).select("key", F.row_number().over(W.orderBy(F.desc("last_used"), "key")).alias("place"))


_TIMES = "(VALUES (1, '2025-12-29T00:00:00', '2025-01-01T00:00:00'), (2, NULL, '2025-12-31T12:00:00'), (3, 'never', NULL), (4, '2025-12-30T06:30:00.250000', NULL)) AS t(id, last_used, created_at)"
_USED = f"SELECT id, coalesce(try_cast(last_used AS TIMESTAMP), try_cast(created_at AS TIMESTAMP), TIMESTAMP '2025-06-01 00:00:00') AS u FROM {_TIMES}"


def _used(spark):
    return inline(spark, _TIMES).withColumn("modified", F.lit("2025-06-01 00:00:00")).select("id", cache_admin.used_at("last_used", "created_at", "modified").alias("at"))


@query("f17_last_used", f"SELECT id, strftime(u, '%Y-%m-%d %H:%M:%S') AS used FROM ({_USED})")
def f17(spark, d):
    return _used(spark).select("id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("used"))


@query("f18_age", f"SELECT id, round(epoch_us(TIMESTAMP '{_NOW}' - u) / 86400000000.0, 6) AS days, u < TIMESTAMP '{_NOW}' - INTERVAL 2 DAY AS old FROM ({_USED})")
def f18(spark, d):
    now = F.lit(_NOW).cast("timestamp")
    return _used(spark).select("id", r8(cache_admin.age_days(F.col("at"), now), 6).alias("days"), (cache_admin.age_days(F.col("at"), now) > 2).alias("old"))


_MANIFESTS = "(VALUES ('a', 1, 3), ('b', 2, 3), ('c', 1, 4), ('d', NULL, NULL), ('e', 1, 0)) AS t(key, format_version, num_batches)"
_PARTS = "(VALUES ('a', 0), ('a', 1), ('a', 2), ('b', 0), ('c', 0), ('c', 2), ('c', 3)) AS p(key, part)"


@query("c1_validity", f"""WITH x AS (SELECT key, min(i) AS missing FROM (SELECT key, unnest(range(0, num_batches)) AS i FROM {_MANIFESTS} WHERE num_batches > 0) e WHERE NOT EXISTS (SELECT 1 FROM {_PARTS} WHERE p.key = e.key AND p.part = e.i) GROUP BY key)
SELECT key, CASE WHEN format_version IS NULL THEN 'no manifest' WHEN format_version <> 1 THEN 'format version ' || format_version WHEN coalesce(num_batches, 0) <= 0 THEN 'no batches' WHEN missing IS NOT NULL THEN 'shard ' || missing || ' is missing' END AS problem FROM {_MANIFESTS} LEFT JOIN x USING (key)""")
def c1(spark, d):
    return cache_admin.validity(inline(spark, _MANIFESTS), inline(spark, _PARTS))
