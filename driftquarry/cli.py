"""score, compare, plot, cache list|gc|clear, floor-sweep, self-test. Exit codes: 0 done, 1 an error the user can act on, 2 no subcommand, 130 interrupted."""

from __future__ import annotations

import argparse
import sys
import time
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftquarry.api import Protocol, build_record, checked_tokenizers, drop_entries, ensure_teacher_cache, entries, identity, record_path, scored_facts
from driftquarry.errors import DriftError
from driftquarry.functions import arrow_kernel, kernel, text
from driftquarry.operators import cache_admin, records, render, sweep
from driftquarry.operators.score import score_student
from driftquarry.operators.students import measured, recipe, unmeasured
from driftquarry.sources import files


def _removed(root: str, which: DataFrame) -> str:
    return "".join(f"removed {key}\n" for key in drop_entries(root, [r[0] for r in which.select("key").collect()]))


def _teacher(ranked: DataFrame, part: str | None) -> str:
    names = [r[0] for r in ranked.select("teacher").distinct().orderBy("teacher").collect()]
    if part:
        names = [n for n in names if part in n]
    if len(names) != 1:
        raise DriftError(f"one teacher is needed, found: {', '.join(names) or 'none'}")
    return names[0]


def _ranked(spark: SparkSession, patterns: list[str]) -> DataFrame:
    valid, rejected = files.load_records(spark, patterns)
    for r in rejected.collect():
        print(f"skipped {r['path']}: {r['reason']}", file=sys.stderr)
    return records.rank_records(valid)


def _doubles(df: DataFrame) -> DataFrame:
    return df.withColumn("logits", F.col("logits").cast(T.ArrayType(T.DoubleType())))


def _score(spark: SparkSession, args: argparse.Namespace) -> str:
    """Score one student's stored logits, write its record, and say how it went."""
    began = time.time()
    protocol = Protocol(args.corpus, args.num_samples, args.max_seq_len, args.seed, args.top_k, Protocol.window(args.window) if args.window else None)
    teacher = _doubles(spark.read.parquet(args.teacher_logits))
    warn = lambda message: print(f"warning: {message}", file=sys.stderr)
    key, found, status = ensure_teacher_cache(teacher, protocol, args.cache, identity(args.teacher), rebuild=args.rebuild, budget=int(args.cache_max_gb * 1e9) if args.cache_max_gb else None, say=warn)
    protocol = protocol.clamped(found["vocab_size"])
    students = kernel.align_vocab(_doubles(spark.read.parquet(args.student_logits)), found["vocab_size"]).select("seq_id", "pos", "logits", "pad_mass")
    worst = students.agg(F.max("pad_mass")).first()[0] or 0.0
    if not worst <= 1e-4:
        warn(f"padded ids hold up to {worst:.2%} of the student's probability")
    facts = scored_facts(spark, args.cache, key, students.drop("pad_mass"), protocol)
    weights = args.weights or args.student
    student = measured(spark, weights) | {"path": args.student} if Path(weights).exists() else unmeasured(args.student)
    made = build_record(facts, protocol, {"path": args.teacher, "tokenizer_hash": found.get("tokenizer_hash")}, student, checked_tokenizers(None, None, "given"), round(time.time() - began, 3), None, found.get("corpus_tokens_hash"), recipe(spark, weights) if Path(weights).is_dir() else None)
    path = record_path(spark, args.out_dir, args.teacher, args.student, protocol, "given")
    files.write_json(path, made)
    if args.report:
        files.write_text(args.report, render.report(spark, made))
    if args.card:
        files.write_text(args.card, render.card(spark, made))
    mean = "n/a" if made["kld"]["mean"] is None else f"{made['kld']['mean']:.4f}"
    return f"{status} {key}: {made['tokens_scored']} tokens, mean KLD {mean}, {path}\n"


def _self_test(spark: SparkSession) -> str:
    """Checks with known answers: even distributions diverge by nothing, a student equal to its teacher by the floor, and a larger head never reconstructs worse."""
    rows = [(0, j, j, True, [float((7 * j + 3 * i) % 13) / 2 for i in range(32)]) for j in range(16)]
    shape = "seq_id int, pos int, token_id int, attn boolean, logits array<double>"
    logits = spark.createDataFrame(rows, shape)
    even = spark.createDataFrame([(0, 0, 0, True, [0.0] * 32)], shape)
    errors = [r["mean_floor"] for r in sweep.floor_sweep(logits, [4, 8, 16, 24], 32).orderBy("k").collect()]
    same = score_student(arrow_kernel.teacher_topk(logits, 8), logits.select("seq_id", "pos", "logits")).select(F.max(F.abs(F.col("kld") - F.col("floor_kld")))).first()[0]
    checks = {"even": abs(arrow_kernel.teacher_topk(even, 8, rounded=False).first()["floor_kld"]) < 1e-9, "same": same < 1e-9, "monotone": all(a >= b - 1e-3 for a, b in zip(errors, errors[1:]))}
    failed = [k for k, ok in checks.items() if not ok]
    if failed:
        raise DriftError(f"self-test failed: {', '.join(failed)}")
    return "".join(f"ok {k}\n" for k in checks)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="driftquarry")
    sub = parser.add_subparsers(dest="command")
    for name in ("compare", "plot"):
        p = sub.add_parser(name)
        p.add_argument("patterns", nargs="+")
        p.add_argument("--teacher")
        p.add_argument("--out")
        p.add_argument("--format" if name == "compare" else "--x", default="md" if name == "compare" else "size")
    cache = sub.add_parser("cache").add_subparsers(dest="action", required=True)
    for name in ("list", "gc", "clear"):
        p = cache.add_parser(name)
        p.add_argument("root")
        p.add_argument("--max-gb", type=float)
        p.add_argument("--older-than", type=float)
        p.add_argument("--teacher")
        p.add_argument("--yes", action="store_true")
    p = sub.add_parser("floor-sweep")
    p.add_argument("logits")
    p.add_argument("--k", required=True)
    p.add_argument("--window")
    p = sub.add_parser("score")
    for name in ("teacher_logits", "student_logits", "teacher", "student", "corpus", "cache", "out_dir"):
        p.add_argument(name)
    for name in ("num-samples", "max-seq-len", "top-k"):
        p.add_argument(f"--{name}", type=int, required=True)
    p.add_argument("--seed", type=int, default=123)
    p.add_argument("--window")
    p.add_argument("--rebuild", action="store_true")
    for name in ("weights", "report", "card"):
        p.add_argument(f"--{name}")
    p.add_argument("--cache-max-gb", type=float)
    sub.add_parser("self-test")
    args = parser.parse_args(argv)
    if not args.command:
        parser.print_usage()
        return 2
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "compare":
            ranked = _ranked(spark, args.patterns)
            name = _teacher(ranked, args.teacher)
            rows = render.ranking(ranked, name)
            out = render.markdown(rows, name) if args.format == "md" else render.as_json(rows, name)
        elif args.command == "plot":
            ranked = _ranked(spark, args.patterns)
            name = _teacher(ranked, args.teacher)
            floor = ranked.where((F.col("teacher") == name) & (F.col("floor_mean") > 0)).select(F.min_by("floor_mean", "load_order")).first()[0]
            out = render.svg(render.plot_points(ranked, name, args.x), "bits per weight" if args.x == "bpw" else "size (GB)", floor)
        elif args.command == "cache":
            found = entries(spark, args.root)
            if args.teacher:
                found = found.where(F.contains("teacher_path", F.lit(args.teacher)))
            if args.action == "list":
                out = "".join(f"{r['key']}  {r['size']}  {r['last_used']}\n" for r in found.orderBy(F.desc("last_used")).select("key", text.human_bytes("size_bytes").alias("size"), "last_used").collect())
            elif args.action == "gc":
                oldest = F.lit(datetime.now(UTC) - timedelta(days=args.older_than)) if args.older_than is not None else None
                plan = cache_admin.collect_garbage(found, int(args.max_gb * 1e9) if args.max_gb is not None else None, oldest)
                out = _removed(args.root, plan.where("reason IS NOT NULL"))
            else:
                if not args.teacher and not args.yes:
                    raise DriftError("clearing everything needs --yes")
                out = _removed(args.root, found.where("NOT locked"))
        elif args.command == "score":
            out = _score(spark, args)
        elif args.command == "self-test":
            out = _self_test(spark)
        else:
            logits = _doubles(spark.read.parquet(args.logits))
            vocab = logits.select(F.size("logits")).first()[0]
            table = sweep.floor_sweep(logits, [int(k) for k in args.k.split(",")], vocab, Protocol.window(args.window) if args.window else None)
            out = "".join(f"{r['k']:>8,}  {r['mean_floor']:.6f}  {r['max_floor']:.6f}{'  <- lowest' if r['is_lowest'] else ''}\n" for r in table.orderBy("k").collect())
        if getattr(args, "out", None):
            files.write_text(args.out, out)
        else:
            sys.stdout.write(out)
    except (DriftError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
