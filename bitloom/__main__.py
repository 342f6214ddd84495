"""Command line for single files: python -m bitloom COMMAND LAYOUT [FILE] [name=value ...].

    parse LAYOUT FILE      the file as JSON
    produce LAYOUT FILE    bytes from a JSON file, to standard output
    check LAYOUT           diagnostics; exit code 1 on errors
    explain LAYOUT         lowering and Spark schema
    info LAYOUT            declarations
    hexdump FILE           offsets, bytes and characters

LAYOUT is a script file or the name of a bundled layout; name=value gives a parameter.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from pathlib import Path

from .functions.reader import Reader, to_json
from .functions.values import CellError
from .functions.writer import Writer
from .plans.layout import Layout, compile_script
from .plans.syntax import LayoutError
from .sources.formats import FORMATS


def script_of(name: str) -> str:
    return FORMATS[name] if name in FORMATS else Path(name).read_text(encoding="utf-8")


def hexdump(data: bytes, width: int = 16) -> Iterator[str]:
    for at in range(0, len(data), width):
        row = data[at : at + width]
        shown = "".join(chr(b) if 32 <= b < 127 else "." for b in row)
        yield f"{at:08x}  {row.hex(' '):<{3 * width - 1}}  {shown}"


def info(layout: Layout) -> Iterator[str]:
    for kind, names in (("struct", layout.structs), ("bits struct", layout.bits), ("enum", layout.enums), ("map", layout.macros), ("param", layout.params)):
        for name in names:
            yield f"{kind} {name}"


def main(args: list[str]) -> int:
    params = dict(a.split("=", 1) for a in args if "=" in a)
    numbers = {k: int(v, 0) for k, v in params.items()}
    words = [a for a in args if "=" not in a]
    if len(words) < 2 or words[0] not in ("parse", "produce", "check", "explain", "info", "hexdump"):
        print(__doc__, file=sys.stderr)
        return 2
    command, first, *rest = words
    try:
        if command == "hexdump":
            print("\n".join(hexdump(Path(first).read_bytes())))
            return 0
        layout = compile_script(script_of(first))
        if command == "parse":
            print(to_json(Reader(layout).read(Path(rest[0]).read_bytes(), None, numbers)[0]))
        elif command == "produce":
            sys.stdout.buffer.write(Writer(layout).write(Path(rest[0]).read_text(encoding="utf-8"), None, numbers))
        elif command == "info":
            print("\n".join(info(layout)))
        elif command == "explain":
            from pyspark.sql import SparkSession

            from .operators import explain

            SparkSession.builder.master("local[1]").getOrCreate()
            print(explain(script_of(first)))
        return 0
    except LayoutError as e:
        print("\n".join(f"{d.level} {d.code}: {d.message}" if hasattr(d, "level") else str(d) for d in e.diagnostics), file=sys.stderr)
    except (CellError, OSError, ValueError) as e:
        print(f"{getattr(e, 'code', 'error')}: {e}", file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
