"""Reports of compressed files as text, and tables of scores against other tools' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.sets import CODECS
from leafmill.functions.text import UNITS, ratio, score_cell, size_cell, truncated_left
from leafmill.operators.compare import least_score

#: Widths of the name column of a score table, at least and at most.
NARROW, WIDE = 4, 60


def human(size: int) -> str:
    value, unit = float(size), 0
    while value >= 1024 and unit < len(UNITS) - 1:
        value, unit = value / 1024, unit + 1
    return f"{value:.1f} {UNITS[unit]}" if unit else f"{size} B"


def change(before: int, after: int) -> str:
    return f"{(after - before) / before * 100:+.1f}%" if before else "-"


def text_of(row) -> str:
    """The report of one row of documents.compressed()."""
    out = [f"{row.doc_id}: {human(row.input_bytes)} -> {human(row.output_bytes)} ({change(row.input_bytes, row.output_bytes)})"]
    if row.refusal:
        return f"{row.doc_id}: refused: {row.refusal}"
    if row.images:
        out.append(f"  {'image':>10} {'size':>12} {'dpi':>6} {'in':>10} {'out':>10}  action")
        out += [f"  {f'{i.num} {i.gen}':>10} {f'{i.width}x{i.height}':>12} {'-' if i.dpi is None else f'{i.dpi:.0f}':>6} {human(i.bytes_in):>10} {human(i.bytes_out):>10}  {i.action}" for i in row.images]
    out += [f"  {s.name:<10} {human(s.bytes_before):>10} -> {human(s.bytes_after):>10} {change(s.bytes_before, s.bytes_after):>8} {s.elapsed_ms:8.1f} ms" for s in row.stages]
    return "\n".join([*out, *(f"  note: {n}" for n in row.notes)])


def score_table(rows: DataFrame, references: list[str]) -> str:
    """A line for each file, then totals, and what each reference covers; rows: file, input, ours, ssim, and a column for each reference.

    Totals of ours and of a reference are over the files that have both, so a refusal doesn't flatter the ratio.
    """
    cells = rows.orderBy("file").select(
        truncated_left(F.col("file"), WIDE).alias("file"), F.col("input").cast("string").alias("input"), size_cell(F.col("ours"), F.col("input")).alias("ours"), score_cell(F.col("ssim")).alias("min ssim"),
        *(size_cell(F.col(r), F.col("input")).alias(r) for r in references),
    )
    both = {r: F.col(r).isNotNull() & F.col("ours").isNotNull() for r in references}
    sums = {r: (F.sum(F.when(c, F.col(r))), F.sum(F.when(c, F.col("input"))), F.sum(F.when(c, F.col("ours")))) for r, c in both.items()}
    known = F.sum(F.when(F.col("ours").isNotNull(), F.col("input")))
    total = rows.agg(
        F.lit("total").alias("file"), F.sum("input").cast("string").alias("input"), size_cell(F.sum("ours"), known).alias("ours"), score_cell(least_score("ssim")).alias("min ssim"),
        *(size_cell(s, base).alias(r) for r, (s, base, _) in sums.items()),
    )
    cover = rows.agg(
        F.lit("coverage").alias("file"), F.lit("").alias("input"), F.lit("").alias("ours"), F.lit("").alias("min ssim"),
        *(F.concat(F.count_if(both[r]).cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string"), F.lit(" ours "), F.coalesce(ratio(mine, base), F.lit("-"))).alias(r) for r, (_, base, mine) in sums.items()),
    )
    lines = [cells.columns, *map(list, cells.collect()), *map(list, total.collect()), *(map(list, cover.collect()) if references else [])]
    lines = [["" if v is None else str(v) for v in line] for line in lines]
    widths = [max(NARROW, *(len(line[k]) for line in lines)) for k in range(len(lines[0]))]
    return "\n".join(" ".join(v.ljust(w) if k == 0 else v.rjust(w) for k, (v, w) in enumerate(zip(line, widths, strict=True))).rstrip() for line in lines)


def references_for(found: DataFrame, preset: str, only: str | None = None, explicit: bool = False) -> DataFrame:
    """The references (name) to compare with: the named one, all where a preset was asked for, else those that end in it."""
    keep = F.col("name") == only if only else F.lit(True) if explicit else F.col("name").endswith(f"-{preset}")
    return found.filter(keep & ~F.col("name").startswith(".")).orderBy("name")


def codecs(names: str) -> str:
    """A comma list of codecs in the order of their bits; an unknown one is an error."""
    given = [n.strip() for n in names.split(",") if n.strip() and n.strip() != "none"]
    if strange := [n for n in given if n not in CODECS]:
        raise ValueError(f"unknown name {strange[0]}; choose from {', '.join(CODECS)}")
    return ",".join(n for n in CODECS if n in given)
