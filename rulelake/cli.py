"""The command line: answers of a session's routes, a read-only HTTP server, and a batch run that writes annotations and analysis."""

from __future__ import annotations

import argparse
import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import engine as E
from .runtime import session as spark_session
from .runtime import ship
from .sources import session as S


def boolean(text: str) -> bool:
    """true or false, nothing else."""
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError(f"true or false, not {text}")
    return text.lower() == "true"


def port(text: str) -> int:
    n = int(text)
    if not 0 < n < 65536:
        raise argparse.ArgumentTypeError("a port lies between 1 and 65535")
    return n


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("rulelake", description="Explore a rulebase or session.")
    p.add_argument("-s", "--session", help="folder of a session's tables")
    p.add_argument("-l", "--layer", action="append", default=[], help="a JSON layer; may be repeated, lowest first")
    p.add_argument("-f", "--facts", help="folder of facts; by default the session's own, or beside it with .facts added")
    p.add_argument("-p", "--port", type=port, default=9999)
    p.add_argument("--working-memory-enabled", type=boolean, default=True)
    p.add_argument("--annotations", help="specification as JSON, or a file with it")
    p.add_argument("--printer", choices=("pretty", "compact"), default="pretty")
    p.add_argument("--generate-analysis", metavar="DIR", help="write annotations and analysis there, and end")
    p.add_argument("--export", metavar="DIR", help="write all answers there as a tree, and end")
    p.add_argument("--load-session-state-fn", help="dotted name of a function that loads the session")
    p.add_argument("--get", metavar="ROUTE", help="print a route's answer, and end")
    return p


def specification(text: str | None, layers: list[str]) -> dict:
    """A specification from JSON or a file of it: one object, nothing after it. Layers stand in for its source."""
    found: dict = {}
    if text:
        body = text if text.lstrip().startswith("{") else Path(text).read_text()
        found = json.loads(body)
        if not isinstance(found, dict):
            raise ValueError("a specification is an object")
    if layers and found.get("source") is None:
        found["source"] = list(layers)
    return found


def printed(answer, pretty: bool) -> str:
    """An answer as JSON; rows are fetched for it, as it goes to one reader."""
    if isinstance(answer, DataFrame):
        answer = [json.loads(r[0]) for r in answer.select(F.to_json(F.struct(*answer.columns))).toLocalIterator()]
    return json.dumps(answer, ensure_ascii=False, indent=2 if pretty else None)


def handler(engine: E.Engine):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            try:
                status, body = 200, printed(engine.get(self.path.split("?")[0]), False)
            except (E.NotFound, E.NoWorkingMemory) as e:
                status, body = e.status, json.dumps({"error": str(e)})
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return Handler


def serve(engine: E.Engine, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that answers until it is shut down; the caller runs serve_forever."""
    return ThreadingHTTPServer((host, port), handler(engine))


def generate(session: S.Session, out: str, layers: list[str], pretty: bool = True) -> None:
    """annotations: the generated layer, a row a rule; analysis: productions and types under properties, generated and given layers."""
    generated = E.generated(session, E.Spec(), 1)
    S.write_layer(generated, f"{out}/annotations")
    a = E.Analysis(session, E.A.props_layer(session["productions"]).unionByName(generated).unionByName(S.read_layers(session.spark, layers, 2)))
    a.summaries.write.mode("overwrite").json(f"{out}/analysis/productions", ignoreNullFields=not pretty)
    a.types.drop("place").write.mode("overwrite").json(f"{out}/analysis/fact-types", ignoreNullFields=not pretty)


def main(argv: list[str] | None = None) -> int:
    o = options().parse_args(argv)
    if not o.session:
        print("a session is needed: -s", file=sys.stderr)
        return 1
    spark = ship(spark_session())
    for path in [o.session] if not o.load_session_state_fn else []:
        if not S.exists(spark, path):
            print(f"there is no {path}", file=sys.stderr)
            return 1
    for path in o.layer:
        if not S.exists(spark, path):
            print(f"there is no {path}", file=sys.stderr)
            return 1
    session = S.load_session(spark, o.session, o.facts, o.load_session_state_fn)
    if o.generate_analysis:
        generate(session, o.generate_analysis, o.layer, o.printer == "pretty")
        return 0
    engine = E.Engine(session, specification(o.annotations, o.layer), o.working_memory_enabled)
    if o.export:
        engine.export(o.export)
        return 0
    if o.get:
        try:
            print(printed(engine.get(o.get), o.printer == "pretty"))
        except (E.NotFound, E.NoWorkingMemory) as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    serve(engine, o.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
