"""A shell: python -m framewright [--catalog FILE] [SCRIPT]; without a script it reads statements from standard input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .catalog.store import Catalog
from .errors import EngineError
from .plans import lexer
from .session import Session


def run(s: Session, script: str, out=sys.stdout) -> bool:
    """Run the statements of a script and print their rows; an error is printed and ends the script. Whether all ran."""
    for text in lexer.split(script):
        try:
            for batch in s.sql(text).stream():
                for row in batch.to_pylist():
                    print("\t".join("NULL" if v is None else str(v) for v in row.values()), file=out)
        except EngineError as e:
            print(e, file=out)
            return False
    return True


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="framewright", description=__doc__)
    p.add_argument("script", nargs="?", help="a file of statements")
    p.add_argument("--catalog", default=":memory:", help="a catalogue file that outlives the shell")
    given = p.parse_args(arguments)
    s = Session(SparkSession.builder.appName("framewright").getOrCreate(), Catalog(given.catalog))
    if given.script:
        with open(given.script, encoding="utf-8") as f:
            return 0 if run(s, f.read()) else 1
    held, ok = "", True
    for line in sys.stdin:
        held += line
        if held.rstrip().endswith(";"):
            ok, held = run(s, held), ""
    return 0 if (run(s, held) if held.strip() else ok) else 1


if __name__ == "__main__":
    sys.exit(main())
