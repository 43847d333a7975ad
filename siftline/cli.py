"""Command line: scan a folder, look for optional engines, write a settings file."""

from __future__ import annotations

import argparse
import importlib.util
import sys
from pathlib import Path

ENGINES = ("pyspark", "pyarrow", "pandas", "numpy", "fitz", "pytesseract", "PIL", "cv2")
OUTPUTS = ("submit", "risk_report", "review_report", "pipeline_report")
ACTIONS = ("scan_only", "plan", "extract", "detect_pii", "risk", "json", *OUTPUTS)


def settle(args: argparse.Namespace) -> argparse.Namespace:
    """Fill in what is left open: without an action, or with a mode, a scan runs to its end and writes all four outputs."""
    acting = any(getattr(args, a) for a in ACTIONS)
    if args.mode or args.fast or not any(getattr(args, a) for a in ("scan_only", "plan", "extract", "detect_pii", "risk")):
        args.mode = args.mode or "fast"
        args.risk = True
        if not acting or not any(getattr(args, o) for o in OUTPUTS):
            for name, file in zip(OUTPUTS, ("submit.txt", "risk_report.md", "review_report.md", "pipeline_report.md"), strict=True):
                setattr(args, name, getattr(args, name) or str(Path(args.out) / file))
    args.mode = args.mode or "normal"
    args.ml = args.ml and not args.no_ml
    return args


def counters(df, *keys: str, title: str) -> None:  # noqa: ANN001
    """A table of counts on the console."""
    from pyspark.sql import functions as F

    print(f"{title}:")
    for r in df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(20).collect():
        print(f"{r.n:>8}  {' / '.join(str(r[k]) for k in keys)}")


def scan(args: argparse.Namespace) -> int:
    args = settle(args)
    root = next((p for p in (Path(args.folder), Path(__file__).parent.parent / args.folder) if p.is_dir()), None)
    if root is None and "://" not in args.folder:
        print(f"no folder {args.folder}", file=sys.stderr)
        return 1
    place = args.folder if root is None else str(root.resolve())

    from pyspark.sql import SparkSession

    from siftline.operators import formats, planner, risk
    from siftline.plans import pipeline, reports
    from siftline.settings import setting
    from siftline.sources import files

    spark = SparkSession.builder.appName("siftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.scan_only or (args.plan and not (args.extract or args.detect_pii or args.risk)):
        inventory = formats.detect_format(files.heads(files.listing(spark, place), formats.SAMPLE_BYTES))
        counters(inventory, "status", "extension", title="types")
        if not args.scan_only:
            counters(planner.plans(inventory), "strategy", title="plans")
        return 0
    if args.ml:
        print("names by a model: no model is built in; give one to scan_folder", file=sys.stderr)
    result = pipeline.scan_folder(spark, place, args.mode, args.max_candidates, ocr_files=args.max_ocr_files, ml_files=args.ml_max_files, extract_limit=args.extract_limit, recognise=True if args.ocr else None)
    threshold = setting("risk.submit") if args.risk_threshold is None else args.risk_threshold
    counters(result.blocks, "extraction_method", title="blocks")
    if args.detect_pii or args.risk:
        counters(result.findings, "category", title="findings")
    if args.risk:
        counters(result.assessed, "level", title="risk")
    if args.submit:
        print(f"{pipeline.write_submit(result.assessed, args.submit, threshold)} files to submit; see {args.submit}")
    if args.risk_report:
        Path(args.risk_report).parent.mkdir(parents=True, exist_ok=True)
        Path(args.risk_report).write_text(risk.report(result.assessed, "submit_path", "Files by risk", 200), "utf-8")
    if args.review_report:
        reports.review_report(result.assessed, args.review_report, threshold)
    if args.pipeline_report:
        reports.pipeline_report(result, args.pipeline_report, args.mode, threshold)
    if args.json:
        reports.export_json(result, args.json)
    return 0


def doctor(args: argparse.Namespace) -> int:
    missing = [m for m in ENGINES if importlib.util.find_spec(m) is None]
    for m in ENGINES:
        print(f"{m:<12} {'missing' if m in missing else 'found'}")
    return int(bool(missing))


def init_config(args: argparse.Namespace) -> int:
    from siftline import settings

    try:
        print(settings.write_template(args.path, args.force))
    except FileExistsError as error:
        print(f"{error} exists; --force overwrites it", file=sys.stderr)
        return 1
    return 0


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="siftline", description=__doc__)
    commands = main.add_subparsers(dest="command")
    one = commands.add_parser("scan")
    one.add_argument("folder", nargs="?", default="share")
    one.add_argument("--mode", choices=("fast", "normal", "hard"))
    one.add_argument("--out", default="out", help="folder of the outputs that are not named")
    for name, text in (("scan-only", "types only"), ("plan", "extraction plans"), ("extract", "text blocks"), ("detect-pii", "findings"), ("risk", "scores"), ("ocr", "recognise pictures"), ("fast", "the fast mode"), ("ml", "names by a model"), ("no-ml", "no model, whatever else is said")):
        one.add_argument(f"--{name}", action="store_true", help=text)
    for name, text in (("extract-limit", "files to extract, in the order of selection"), ("max-ocr-files", "files whose pictures are recognised"), ("max-candidates", "files to choose"), ("ml-max-files", "files that a model reads")):
        one.add_argument(f"--{name}", type=int, help=text)
    one.add_argument("--risk-threshold", "--threshold", type=float, help="score from which files are submitted")
    for name in ("submit", "risk-report", "pipeline-report", "review-report", "json"):
        one.add_argument(f"--{name}", help="where to write it")
    one.set_defaults(run=scan)
    commands.add_parser("doctor").set_defaults(run=doctor)
    two = commands.add_parser("init-config")
    two.add_argument("path", nargs="?", default="siftline_settings.json")
    two.add_argument("--force", action="store_true")
    two.set_defaults(run=init_config)
    return main


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in ("scan", "doctor", "init-config", "-h", "--help"):
        argv.insert(0, "scan")
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 0
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
