"""python -m factloom FILE… [--steps N] [--count PATTERN]… [--out FOLDER]: loads files of terms, fires their rules and prints counts or terms."""

import argparse
from functools import reduce

from factloom.plans.rules import Program
from factloom.session import local_session
from factloom.space import Space


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom", description=__doc__)
    parser.add_argument("files", nargs="+")
    parser.add_argument("--steps", type=int, default=1000, help="rules to fire at most")
    parser.add_argument("--count", action="append", default=[], metavar="PATTERN", help="print the number of matches instead of all terms")
    parser.add_argument("--out", metavar="FOLDER", help="write the terms there instead of printing them")
    asked = parser.parse_args(args)
    spark = local_session(app="factloom")
    program = Program(reduce(Space.union, (Space.read_text(spark, f) for f in asked.files)))
    space = program.run(asked.steps)
    print(f"; {program.fired} rules fired, {space.count()} terms, {space.rejected_count()} rejected")
    for pattern in asked.count:
        print(f"{space.count_matches(pattern)}\t{pattern}")
    if asked.out:
        space.dump(asked.out)
    elif not asked.count:
        for row in space.atoms.select("term").orderBy("term").toLocalIterator():
            print(row.term)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
