"""String predicates, classifications and renderings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- specifications and rows -------------------------------------------------


def split_spec(spec: Column | str) -> Column:
    """struct(path, subset): cut at the first colon; nothing after it means there is no subset and the colon belongs to the path."""
    s = _c(spec)
    at = F.instr(s, ":")
    cut = (at > 0) & (at < F.length(s))
    return F.struct(F.when(cut, F.substring(s, F.lit(1), at - 1)).otherwise(s).alias("path"), F.when(cut, F.substring(s, at + 1, F.length(s))).alias("subset"))


def nonblank(text: Column | str) -> Column:
    """Some character is not white space in Unicode's sense."""
    return F.coalesce(_c(text).rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def window_label(window: Column | str) -> Column:
    """start:end of a score window, or n/a."""
    w = _c(window)
    return F.when(F.size(w) >= 2, F.concat_ws(":", F.get(w, F.lit(0)), F.get(w, F.lit(1)))).otherwise("n/a")


# --- names -------------------------------------------------------------------


def _last(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def publisher(path: Column | str) -> Column:
    """The organisation in a directory named ORG__REPO: of the directory that holds a .gguf file, else of the path's last part."""
    p = _c(path)
    parts = F.split(p, "/")
    holder = F.when(F.lower(p).endswith(".gguf"), F.try_element_at(parts, F.lit(-2))).otherwise(F.element_at(parts, -1))
    return F.when(F.contains(holder, F.lit("__")), F.substring_index(holder, "__", 1))


def teacher_slug(path: Column | str) -> Column:
    """A directory name: organisation and name of a hub id or of a snapshot's models-- part, else the last part; in lower case."""
    p = F.regexp_replace(_c(path), "/+$", "")
    snapshot = F.regexp_extract(p, r"(?:^|/)models--([^/]*)", 1)
    pair = F.regexp_replace(F.substring_index(p, "/", -2), "/", "__")
    return F.lower(F.when(snapshot != "", F.replace(snapshot, F.lit("--"), F.lit("__"))).when(F.contains(p, F.lit("/")) & ~p.startswith("/"), pair).otherwise(_last(p)))


def student_slug(path: Column | str) -> Column:
    return F.regexp_replace(_last(F.regexp_replace(_c(path), "/+$", "")), r"\.gguf$", "")


def public_name(path: Column | str) -> Column:
    """A hub id as it is; a local path by its slug only; nothing as unknown."""
    p = F.regexp_replace(F.coalesce(_c(path), F.lit("")), "/+$", "")
    return F.when(p == "", "unknown").when(p.rlike("^[/~.]"), teacher_slug(p)).otherwise(p)


NOISE = ("mlx", "vl", "it", "instruct", "gguf", "mtp")


def teacher_base(path: Column | str) -> Column:
    """A model's name without organisation and precision."""
    return F.regexp_replace(F.regexp_replace(_last(_c(path)), "^.*?__", ""), r"(?i)[-_.](bf16|fp16|f16|f32)$", "")


def short_label(name: Column | str, base: Column | str) -> Column:
    """What a student's name adds to its teacher's, without noise words at either end; without a common part, the name less its organisation. 4bit reads q4."""
    n, b = F.regexp_replace(_c(name), r"\.gguf$", ""), _c(base)
    at = F.when(b != "", F.instr(F.lower(n), F.lower(b))).otherwise(0)
    rest = F.regexp_replace(F.substring(n, at + F.length(b), F.length(n)), r"^[-_. ]+|[-_. ]+$", "")
    words = "|".join(NOISE)
    # A noise word goes only while another part is left.
    trimmed = F.regexp_replace(F.regexp_replace(rest, f"(?i)^(?:(?:{words})-)+", ""), f"(?i)(?:-(?:{words}))+$", "")
    plain = F.regexp_replace(n, "^.*?__", "")
    label = F.when((at > 0) & (trimmed != ""), trimmed).otherwise(F.when(plain != "", plain).otherwise(n))
    return F.regexp_replace(label, r"(?i)^(\d+)bit$", "q$1")


def codec_family(codec: Column | str) -> Column:
    c = F.lower(_c(codec))
    return F.when(c.isin("f32", "f16", "bf16"), F.lit(None).cast("string")).when(c.rlike("^q[0-9]+_k"), "K-quant").when(c.startswith("iq"), "IQ").when(c.startswith("mxfp"), "MXFP4").otherwise("GGUF")


FAMILIES = ("K-quant", "IQ", "MXFP4", "GGUF")


def is_commit_sha(text: Column | str) -> Column:
    return F.coalesce(_c(text).rlike("^[0-9a-fA-F]{40}$"), F.lit(False))


# --- tensors -----------------------------------------------------------------


def _tail(*names: str) -> str:
    return r"\.(?:" + "|".join(names) + ")$"


def _part(*names: str) -> str:
    return r"(?:^|\.)(?:" + "|".join(names) + r")\."


_LINEAR = ("in_proj_qkv", "in_proj_z", "out_proj", "conv1d", "dt_proj")
_MLP = ("gate_proj", "up_proj", "down_proj", "gate_up_proj")
_BRIDGE = ("merger", "connector", "multi_modal_projector", "vl_connector")
_SIGHT, _SOUND, _EMBEDDED = ("visual", "vision_tower", "vision_model"), ("audio_tower", "audio_model"), ("embed_vision", "embed_audio")

#: (role, pattern) in order; the first that is found anywhere in a name gives its role.
ROLES: list[tuple[str, str]] = [
    ("embedding", r"\b(?:" + "|".join(("embed_tokens", "wte", "word_embeddings")) + r")\b"),
    ("lm_head", r"(?:^|\.)lm_head$"),
    *[(f"attn.{x}_proj", _tail(f"{x}_proj")) for x in "qkvo"],
    ("attn.qkv_proj", _tail("qkv_proj", "qkv")),
    ("attn.out_proj", _tail("out_proj", r"attn\.proj")),
    *[(f"linear_attn.{x}", _tail(rf"linear_attn\.{x}")) for x in _LINEAR],
    ("linear_attn.norm", r"\.linear_attn\.norm"),
    ("linear_attn.other", r"\.linear_attn\."),
    *[(f"mlp.{x}", _tail(rf"mlp\.{x}")) for x in _MLP],
    ("experts.gate_up", r"\.experts" + r"\.(?:switch_mlp\.)?" + "(?:" + "|".join(("gate_up_proj", "gate_proj", "up_proj")) + ")$"),
    ("experts.down", r"\.experts" + r"\.(?:switch_mlp\.)?" + "down_proj$"),
    ("router", r"\.(?:router|gate)(?:\.(?:weight|w1|w2))?$"),
    ("shared_expert", r"\.shared_expert(?:_gate|\.)"),
    ("norm", r"(?:[._]norm|[._]layernorm|\.rmsnorm)$"),
    ("vlm.merger", _part(*_BRIDGE)),
    ("vlm.patch_embed", r"\.patch_embed"),
    ("vlm.visual", _part(*_SIGHT)),
    ("vlm.audio", _part(*_SOUND)),
    ("vlm.projector", _part(*_EMBEDDED)),
]
UNSCORED = _part("mtp", *_SIGHT, *_SOUND, *_BRIDGE, *_EMBEDDED) + r"|\.patch_embed"


def role(base: Column | str) -> Column:
    out = None
    for name, pattern in ROLES:
        hit = _c(base).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def layer_index(base: Column | str) -> Column:
    return F.expr(r"try_cast(nullif(regexp_extract({}, r'\.layers\.([0-9]+)\.', 1), '') AS INT)".format(base))


def is_scored(base: Column | str) -> Column:
    """Weights that scoring loads: neither draft heads nor towers for pictures or sound."""
    return ~_c(base).rlike(UNSCORED) & ~role(base).startswith("vlm.")


# --- numbers -----------------------------------------------------------------


def fixed(v: Column | str, digits: int = 4) -> Column:
    """Fixed decimals, or two significant digits in scientific form where a nonzero value would show as zero."""
    x = _c(v)
    small = (x != 0) & (F.abs(x) < 0.5 * 10.0**-digits)
    return F.when(x.isNull(), "n/a").when(small, F.format_string("%.1e", x)).otherwise(F.format_string(f"%.{digits}f", x))


def percent(v: Column | str, digits: int = 2) -> Column:
    return F.when(_c(v).isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f%%", _c(v) * 100))


def _plus_minus(render, mean: Column | str, se: Column | str, digits: int) -> Column:
    m, s = _c(mean), _c(se)
    return F.when(m.isNull(), "n/a").when(s.isNull(), render(m, digits)).otherwise(F.concat(render(m, digits), F.lit(" +/- "), render(s, digits)))


def plus_minus(mean: Column | str, se: Column | str, digits: int = 4) -> Column:
    return _plus_minus(fixed, mean, se, digits)


def points(v: Column | str, digits: int = 3) -> Column:
    """A difference of probabilities in percentage points."""
    return F.when(_c(v).isNull(), "n/a").otherwise(F.concat(fixed(_c(v) * 100.0, digits), F.lit("%")))


def points_plus_minus(mean: Column | str, se: Column | str, digits: int = 3) -> Column:
    return _plus_minus(points, mean, se, digits)


def parameters(n: Column | str) -> Column:
    x = _c(n)
    return F.when(x >= 1e9, F.format_string("%.2fB", x / 1e9)).otherwise(F.format_string("%.0fM", x / 1e6))


def cell(v: Column | str, kind: str) -> Column:
    """A table cell: gb, pct, kld, bpw or the value as it is."""
    x = _c(v)
    shown = {"gb": lambda: F.format_string("%.2f GB", x / 1e9), "pct": lambda: percent(x), "kld": lambda: fixed(x), "bpw": lambda: F.format_string("%.3f", x)}
    return F.when(x.isNull(), "n/a").otherwise(shown.get(kind, lambda: x.cast("string"))())


def human_bytes(n: Column | str) -> Column:
    """Decimal units up to TB; bytes as whole numbers."""
    x = _c(n).cast("double")
    size = F.abs(x)
    out = F.when(size < 1e3, F.concat(F.format_string("%d", x.cast("long")), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = out.when(size < 1e3 ** (power + 1), F.format_string(f"%.1f {unit}", x / 1e3**power))
    return out.otherwise(F.format_string("%.1f TB", x / 1e12))


def xml_escape(s: Column | str) -> Column:
    out = _c(s)
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


# --- digests -----------------------------------------------------------------


def _python(x: Column) -> Column:
    """A value as it prints in a digest's input; null is the word None."""
    return F.coalesce(x.cast("string"), F.lit("None"))


def _pair(w: Column) -> Column:
    return F.when(w.isNull(), "None").otherwise(F.concat(F.lit("["), F.array_join(F.transform(w, lambda x: x.cast("string")), ", "), F.lit("]")))


def run_digest(corpus: str, num_samples: str, max_seq_len: str, seed: str, top_k: str, window: str, mode: str, identity: str) -> Column:
    """Eight hex digits of the protocol, for a record's file name."""
    parts = [_python(F.col(c)) for c in (corpus, num_samples, max_seq_len, seed, top_k)] + [_pair(F.col(window)), _python(F.col(mode)), _python(F.col(identity))]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8)


def cache_key(identity: str, dataset: str, num_samples: str, max_seq_len: str, seed: str, top_k: str, version: int = 1) -> Column:
    """Sixteen hex digits of what a cache entry depends on. The score window is left out: all positions are kept."""
    parts = [_python(F.col(c)) for c in (identity, dataset, num_samples, max_seq_len, seed, top_k)]
    return F.substring(F.sha2(F.concat_ws("|", *parts, F.lit(f"v{version}")), 256), 1, 16)


def vocabulary_hash(entries: Column, size: Column, special: dict[str, Column]) -> Column:
    """sha256 of a vocabulary's behaviour: its size, (id, token) in order of id, special ids."""
    lines = F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["id"].cast("string"), F.lit("\t"), e["token"], F.lit("\n"))), "")
    tail = [F.concat(F.lit(f"{name}="), _python(v), F.lit("\n")) for name, v in special.items()]
    return F.sha2(F.concat(F.lit("vocab_size="), size.cast("string"), F.lit("\n"), lines, *tail), 256)
