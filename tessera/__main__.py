"""Run a program file over the inputs 0 … n-1, or over one input, and print the results.

python -m tessera PROGRAM [--input N | --rows N] [--explain] [--time]
"""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.plans.program import Program, pretty


def main(argv: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("program", type=Path)
    p.add_argument("--input", type=int)
    p.add_argument("--rows", type=int, default=1)
    p.add_argument("--explain", action="store_true")
    p.add_argument("--time", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    program = Program(a.program.read_text())
    rows = spark.range(a.input, a.input + 1) if a.input is not None else spark.range(a.rows)
    began = time.perf_counter()
    done = program.apply(rows, "id").orderBy("id")
    if a.explain:
        done.explain("formatted")
    got = done.collect()
    lines = [f"shape {program.shape}, {'total' if program.total else 'fallible'}", pretty(program.shape, [r.result for r in got if not r.err])]
    lines += [f"{sum(r.err for r in got)} of {len(got)} rows failed"] * (not program.total) + [f"{time.perf_counter() - began:.3f} s"] * a.time
    print("\n".join(lines))
    return "\n".join(lines)


if __name__ == "__main__":
    main()
