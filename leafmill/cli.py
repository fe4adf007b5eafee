"""Compresses files from the command line: python -m leafmill.cli [--less | --standard | --more] FILE..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from leafmill.functions.sets import STRIP
from leafmill.operators.presets import PRESETS
from leafmill.report import codecs, text_of
from leafmill.session import session
from leafmill.sources.documents import compressed


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="leafmill", description=__doc__)
    out.add_argument("inputs", nargs="+", type=Path)
    out.add_argument("-o", "--output", type=Path, help="a file, or a folder if it is one or there are several inputs")
    kind = out.add_mutually_exclusive_group()
    for name in PRESETS:
        kind.add_argument(f"--{name}", dest="preset", action="store_const", const=name)
    out.add_argument("--dpi", type=float, help="resolution after downsampling, for all images")
    out.add_argument("--threshold-dpi", type=float, help="downsample only above this; negative: never")
    out.add_argument("--quality", type=int, choices=range(1, 101), metavar="1-100")
    for kind_ in ("bitonal", "continuous", "indexed"):
        out.add_argument(f"--{kind_}-codecs", dest=kind_, type=codecs, metavar="LIST")
    out.add_argument("--strip", type=_strip, metavar="LIST")
    for flag in ("clip", "reduce", "rgb", "subset", "cff", "unembed"):
        out.add_argument(f"--{flag}", action=argparse.BooleanOptionalAction)
    out.add_argument("--no-verify", action="store_true")
    out.add_argument("--dry-run", action="store_true", help="write nothing")
    return out


def _strip(names: str) -> str:
    given = [n.strip() for n in names.split(",") if n.strip() and n.strip() != "none"]
    if strange := [n for n in given if n not in STRIP]:
        raise argparse.ArgumentTypeError(f"unknown name {strange[0]}; choose from {', '.join(STRIP)}")
    return ",".join(given)


def settings(args: argparse.Namespace) -> dict:
    """The preset with what was given put over it."""
    given = {"target": args.dpi, "threshold": args.threshold_dpi} | {k: getattr(args, k) for k in ("quality", "bitonal", "continuous", "indexed", "strip", "clip", "reduce", "rgb", "subset", "cff", "unembed")}
    out = PRESETS[args.preset or "standard"] | {k: v for k, v in given.items() if v is not None}
    if out["threshold"] >= 0 and not (out["target"] > 0 and out["threshold"] >= out["target"]):
        raise SystemExit("the threshold must not be below the resolution, which must be positive")
    return out


def target(source: Path, output: Path | None, several: bool) -> Path:
    name = f"{source.stem}-compressed.pdf"
    if output is None:
        return source.with_name(name)
    return output / name if several or output.is_dir() else output


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    rows, failed = [], 0
    for path in args.inputs:
        try:
            rows.append((str(path), bytearray(path.read_bytes())))
        except OSError as e:
            print(f"{path}: {e.strerror}", file=sys.stderr)
            failed += 1
    df = spark.createDataFrame(rows, "path string, content binary").repartition(max(1, len(rows)))
    for row in compressed(df, settings(args), check=not args.no_verify).toLocalIterator():
        print(text_of(row))
        failed += row.refusal is not None
        if not args.dry_run and row.refusal is None:
            to = target(Path(row.doc_id), args.output, len(args.inputs) > 1)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(row.output)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
