"""A small shell: ``python -m seriate.cli [SCRIPT]``. Lines are gathered to a program that ``exec`` runs; other commands act at once."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterable

from pyspark.sql import SparkSession

from seriate.engine import Engine
from seriate.plans.parser import parse

HELP = """f FILE: add a file to the program; exec: run the program and show results; xexec: run it without a prompt for more; r TEXT: run a statement; print: show the program;
save FILE; clear; list table; stats [on|off|reset]; parse TEXT: show the nodes; script FILE; echo TEXT; exit. Lines that begin with # are comments."""


class Shell:
    def __init__(self, engine: Engine, out=print, rows: int = 20):
        self.engine, self.out, self.rows = engine, out, rows
        self.program: list[str] = []
        self.timing, self.total = False, 0.0

    def command(self, line: str) -> bool:
        """Do a line; False when it ends the session."""
        word, _, rest = line.strip().partition(" ")
        rest = rest.strip()
        if not word or word.startswith("#"):
            return True
        known = {"f", "exec", "xexec", "r", "print", "save", "clear", "list", "stats", "parse", "script", "echo", "help", "exit", "quit", "procedure"}
        if word.lower() not in known:
            self.program.append(line)
        elif word in ("exit", "quit"):
            return False
        elif word in ("exec", "xexec"):
            text, self.program = "\n".join(self.program), []
            self.run(text)
        elif word == "r":
            self.run(rest)
        elif word == "procedure":
            self.run(line)
        elif word == "f":
            with open(rest) as f:
                self.program.append(f.read())
        elif word == "script":
            with open(rest) as f:
                return self.lines(f)
        elif word == "print":
            self.out("\n".join(self.program))
        elif word == "save":
            with open(rest, "w") as f:
                f.write("\n".join(self.program))
        elif word == "clear":
            self.program = []
        elif word == "list":
            for name, df in self.engine.frames.items():
                self.out(f"{name}({', '.join(f'{c} {t}' for c, t in df.dtypes if c not in self.engine.hidden)})")
        elif word == "stats":
            if rest in ("on", "off"):
                self.timing = rest == "on"
            elif rest == "reset":
                self.total, self.engine.stats = 0.0, []
            else:
                self.out(json.dumps({"total_s": round(self.total, 3), "statements": len(self.engine.stats), "parse_s": round(sum(s["parse_s"] for s in self.engine.stats), 3), "plan_s": round(sum(s["plan_s"] for s in self.engine.stats), 3)}))
        elif word == "parse":
            self.out(json.dumps([repr(s) for s in parse(rest)], indent=1))
        elif word == "echo":
            self.out(rest)
        else:
            self.out(HELP)
        return True

    def run(self, text: str) -> None:
        began = time.perf_counter()
        try:
            for df in self.engine.run(text):
                if df is not None:
                    self.out(df.limit(self.rows).toPandas().to_string(index=False))
        except Exception as e:  # noqa: BLE001
            self.out(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
        took = time.perf_counter() - began
        self.total += took
        if self.timing:
            self.out(f"{took:.3f} s")

    def lines(self, lines: Iterable[str]) -> bool:
        for line in lines:
            if not self.command(line.rstrip("\n")):
                return False
        return True


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("seriate").getOrCreate()
    shell = Shell(Engine(spark, keep_order=True, show_order=True, procedures="procedures"))
    if args:
        with open(args[0]) as f:
            shell.lines(f)
        return
    while True:
        try:
            if not shell.command(input("> ")):
                return
        except EOFError:
            return


if __name__ == "__main__":
    main(sys.argv[1:])
