"""Command line: ``python -m pathloom.cli [options] [input]``; ``cluster [file]`` lists clusters however few there are.

``parse``, ``normalize``, ``explain`` or ``stats`` before the input prints the rows of that table, parted by tabs.

The input is a URL, a text file, or standard input. Without a section (-n -c -p
-e) a URL is parsed and normalised, and a text's URLs are listed, or clustered
if there are ten or more. Output streams: nothing is held whole in the driver.
Standard input is taken in chunks of what has arrived: each is committed (to the
corpus, or to one that is gone afterwards), and with a section its URLs are
printed before the next is read.

Exit codes: 1 for a wrong option, file or corpus, 2 for input that is no URL,
141, without a word, when nobody reads the output any more.
"""

from __future__ import annotations

import argparse
import json
import os
import select
import sys
import uuid
from collections.abc import Iterator
from importlib.metadata import PackageNotFoundError, version

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.extract import extract_urls
from .functions.trace import explain_urls, trace_urls
from .functions.urls import normalize_urls, parse_urls
from .operators.learn import cross_host_shapes, proposals
from .operators.report import cluster_json, cluster_lines
from .operators.views import Observed, observe, stats, url_list
from .sources.logs import literal_log, text_file
from .sources.files import Folder
from .sources.store import Commit, Corpus, corpus_path, open_corpus
from .sources.tables import kept, shared_dir

#: So many URLs are clustered rather than listed.
LARGE = 10
SECTIONS = ("parse", "canonical", "normalize", "explain")
#: Bytes of standard input that are taken at once, and seconds that a shorter chunk waits for more.
CHUNK, WAIT = 1 << 26, 0.2


class Failure(Exception):
    """What ends a command: a message and the exit code."""

    def __init__(self, message: str, code: int = 1):
        super().__init__(message)
        self.code = code


def release() -> str:
    try:
        return version("pathloom")
    except PackageNotFoundError:
        return "0.3.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-V", "--version", action="version", version=f"%(prog)s {release()}")
    p.add_argument("input", nargs="*", help="a URL, a file, or - for standard input; before it, cluster")
    for short, name, text in (("-n", "normalize", "shape: variable parts become placeholders"), ("-c", "canonical", "clean form"), ("-p", "parse", "parsed fields"), ("-e", "explain", "trace with notes")):
        p.add_argument(short, f"--{name}", action="append_const", dest="sections", const=name, help=text)
    p.add_argument("-j", "--json", action="store_true", help="JSON; lists as one array")
    p.add_argument("-J", "--ndjson", action="store_true", help="one JSON value a line")
    p.add_argument("-N", "--no-hints", action="store_true", help="{integer} instead of {user_id}")
    p.add_argument("--no-scheme-less", action="store_true", help="no hosts without a scheme")
    p.add_argument("--host", default="full", choices=["full", "registrable", "none"])
    p.add_argument("--corpus", default="", help="a directory, or a .json file")
    p.add_argument("-C", "--no-corpus", action="store_true")
    for name in ("reset", "stats", "reinfer", "propose-recognizers", "cross-host-shapes"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--activate-above", type=float, default=0.0)
    p.add_argument("--min-observations", type=int, default=0)
    p.add_argument("--min-coverage", type=float, default=0.0)
    p.add_argument("--min-hosts", type=int, default=0)
    return p


def read_log(spark: SparkSession, source: str, *, scheme_less: bool = True, file: bool = False) -> DataFrame:
    """The log of a URL, or of the URLs of a text file in the order of its lines; ``file``: it is a file, wherever it is."""
    if not file and ("://" in source or not os.path.exists(source)):
        return literal_log(spark, [source])
    found = extract_urls(text_file(spark, source), scheme_less=scheme_less)
    # A line holds less than 2**29 URLs: a string has less than 2**31 bytes, and a URL with what parts it from the next seven.
    return found.select((F.col("line_id") * (1 << 29) + F.col("pos")).alias("obs_id"), F.col("iri.canonical").alias("url"))


def _fields(i: Column) -> Column:
    """A parsed URL as JSON: fields that are empty are left out."""
    def unless(c: Column, empty: Column) -> Column:
        return F.when(~empty, c)

    params = unless(F.map_from_entries(i["params"]), F.size(i["params"]) == 0)
    return F.to_json(F.struct(
        i["original"].alias("original"), i["kind"].alias("kind"), i["scheme"].alias("scheme"), unless(i["host"], i["host"] == "").alias("host"), i["port"].alias("port"), unless(i["path_segments"], F.size(i["path_segments"]) == 0).alias("path_segments"),
        params.alias("query_params"), unless(i["fragment"], i["fragment"] == "").alias("fragment"), unless(i["nss"], i["nss"] == "").alias("nss"), i["canonical"].alias("canonical"),
    ))


def sections(log: DataFrame, names: list[str], *, hints: bool = True, informed: DataFrame | None = None) -> DataFrame:
    """(obs_id, and a JSON column for each section) of a log, in order; the normal form is that of ``informed`` (obs_id, normalized), if given."""
    t = trace_urls(parse_urls(log), hints=hints).where("iri.error is null")
    made = {"parse": _fields(F.col("iri")), "canonical": F.to_json(F.struct(F.col("iri.canonical").alias("v"))), "explain": F.to_json(F.col("trace").dropFields("evidence"))}
    df = t.select("obs_id", F.col("trace.normalized").alias("_n"), *(made[n].alias(n) for n in names if n != "normalize"))
    if "normalize" in names:
        if informed is not None:
            df = df.drop("_n").join(informed.withColumnRenamed("normalized", "_n"), "obs_id")
        df = df.withColumn("normalize", F.to_json(F.struct(F.col("_n").alias("v"))))
    return df.select("obs_id", *names).orderBy("obs_id")


def _value(name: str, text: str):
    got = json.loads(text)
    return got.get("v") if name in ("canonical", "normalize") else got


def _parsed_text(v: dict) -> str:
    def shown(k: str, x) -> str:
        if k == "query_params":
            return "{" + ", ".join(f"{json.dumps(a)} => {'nil' if b is None else json.dumps(b)}" for a, b in x.items()) + "}"
        return json.dumps(x) if isinstance(x, list) else str(x)

    return "\n".join(f"{k + ':':<15}{shown(k, x)}" for k, x in v.items())


def _explained_text(v: dict) -> str:
    out = [v["normalized"]]
    for part in ("path", "query"):
        rows = [(f"{r['name']}={r['value']}" if r["name"] else r["value"], r["type"], r["output"], r["notes"]) for r in v[part]]
        if rows:
            wide = [max(len(r[k]) for r in rows) for k in range(3)]
            out += ["", f"{part}:"] + [f"  {a:<{wide[0]}}  {b:<{wide[1]}}  {c:<{wide[2]}}" + (f"  ({'; '.join(n)})" if n else "") for a, b, c, n in rows]
    return "\n".join(out)


def _text(name: str, value) -> str:
    return {"parse": _parsed_text, "explain": _explained_text}.get(name, str)(value)


def _json_lines(values: Iterator, many_lines: bool) -> Iterator[str]:
    """One value a line, or the pieces of one array."""
    if many_lines:
        yield from (json.dumps(v, ensure_ascii=False) for v in values)
        return
    first = True
    for v in values:
        yield ("[" if first else ",") + json.dumps(v, ensure_ascii=False)
        first = False
    yield "[]" if first else "]"


def _section_lines(rows: DataFrame, names: list[str], a: argparse.Namespace, single: bool) -> Iterator[str]:
    each = ({n: _value(n, r[n]) for n in names} for r in rows.toLocalIterator())
    if a.json or a.ndjson:
        values = (v[names[0]] if len(names) == 1 else {n: v[n] for n in SECTIONS if n in v} for v in each)
        yield from (json.dumps(v, ensure_ascii=False) for v in values) if single else _json_lines(values, a.ndjson)
        return
    for i, v in enumerate(each):
        if not single and names not in (["normalize"], ["canonical"]):
            yield ("\n" if i else "") + f"# {(v.get('parse') or v.get('explain') or {}).get('canonical') or v.get('canonical') or v.get('normalize') or v[names[0]]['input']}"
        for k, n in enumerate(names):
            if k:
                yield ""
            if single and len(names) > 1:
                yield f"# {n}"
            yield _text(n, v[n])


def _cluster_lines(o: Observed, a: argparse.Namespace) -> Iterator[str]:
    if a.json or a.ndjson:
        rows = cluster_json(o).orderBy(F.desc("n"), "ord").select("json")
        yield from _json_lines((json.loads(r[0]) for r in rows.toLocalIterator()), a.ndjson)
        return
    for i, r in enumerate(cluster_lines(o, hints=not a.no_hints).orderBy(F.desc("n"), "ord").select("text").toLocalIterator()):
        yield ("\n" if i else "") + r[0]


def _list_lines(log: DataFrame, a: argparse.Namespace) -> Iterator[str]:
    found = parse_urls(log).where("iri.error is null")
    c = kept(url_list(found.withColumnRenamed("obs_id", "line_id").withColumn("pos", F.lit(0))), "list")
    if a.json or a.ndjson:
        yield from _json_lines(({"iri": r[0], "count": r[1]} for r in c.toLocalIterator()), a.ndjson)
        return
    repeated = not c.where("n > 1").isEmpty()
    yield from (f"[{r[1]}] {r[0]}" if repeated else r[0] for r in c.toLocalIterator())


def _stats_lines(o: Observed, a: argparse.Namespace) -> Iterator[str]:
    out: dict[str, dict[str, int]] = {}
    for r in stats(o).collect():  # at most 32 rows
        out.setdefault(r[0], {})[r[1]] = r[2]
    top = {k: dict(sorted(out.get(k, {}).items(), key=lambda x: (-x[1], x[0]))) for k in ("hosts", "shapes", "raw_shapes")}
    n, k = out["observations"][""], out["clusters"][""]
    if a.json or a.ndjson:
        yield json.dumps({"observations": n, "clusters": k, **top}, ensure_ascii=False)
        return
    yield f"observations: {n}\nclusters:     {k}\n\ntop hosts:"
    yield from (f"  {v:>6}  {x}" for x, v in top["hosts"].items())
    yield "\ntop shapes:"
    yield from (f"  {v:>6}  {x}" for x, v in top["raw_shapes" if a.no_hints else "shapes"].items())


def _proposal_lines(corpus: Corpus, a: argparse.Namespace) -> Iterator[str]:
    if a.activate_above > 0:
        held = corpus.activations()
        new = corpus.activate_above(a.activate_above)[len(held) :]
        yield from (f"activated: {t} ({p})" for p, t in new) if new else [f"no proposals at or above confidence {a.activate_above:g}"]
        return
    found = proposals(corpus.observed(), min_observations=a.min_observations, min_coverage=a.min_coverage, min_hosts=a.min_hosts)
    if a.json or a.ndjson:
        yield from _json_lines((r.asDict() for r in found.toLocalIterator()), a.ndjson)
        return
    none = True
    for r in found.toLocalIterator():
        yield ("" if none else "\n") + f"proposal: {r['type']} ({r['prefix']})\n  coverage:    {r['coverage']:.2f}\n  confidence:  {r['confidence']:.2f}\n  observations: {r['observations']}\n  hosts:       {r['hosts']}\n  samples:     {', '.join(r['samples'][:3])}"
        none = False
    if none:
        yield f"no recognizer proposals ({corpus.log().count()} observations scanned)"


def _shared_lines(o: Observed, a: argparse.Namespace) -> Iterator[str]:
    found = cross_host_shapes(o, a.min_hosts)
    if a.json or a.ndjson:
        yield from _json_lines(({"shape": r["shape"], "hosts": r["hosts"], "host_count": r["n_hosts"], "observation_count": r["observations"]} for r in found.toLocalIterator()), a.ndjson)
        return
    none = True
    for r in found.toLocalIterator():
        none = False
        yield f"{r['shape']}  ({r['n_hosts']} host{'s' * (r['n_hosts'] != 1)}: {', '.join(r['hosts'])})  obs={r['observations']}"
    if none:
        n = o.urls.select("cluster_key").distinct().count()
        yield f"no cross-host shapes ({n} cluster{'s' * (n != 1)} scanned)"


#: What a word before the input makes of its log.
TABLES = {
    "parse": lambda log: parse_urls(log).select("obs_id", "iri.*"),
    "normalize": normalize_urls,
    "explain": explain_urls,
    "stats": lambda log: stats(observe(log, keep=True)),
}


def _table_lines(df: DataFrame) -> Iterator[str]:
    yield "\t".join(df.columns)
    yield from ("\t".join(map(str, r)) for r in df.toLocalIterator())


def stdin_chunks() -> Iterator[bytes]:
    """Whole lines of standard input: what has arrived when it pauses, and at most about CHUNK bytes."""
    source, held, size = sys.stdin.buffer, [], 0
    try:
        fd = sys.stdin.fileno()
    except (OSError, ValueError):
        fd = None
    while True:
        if fd is not None and size and not select.select([fd], [], [], WAIT)[0]:
            data, paused = b"", True
        else:
            data, paused = (source.read(1 << 20) if fd is None else os.read(fd, 1 << 20)), False
            if not data:
                break
            held.append(data)
            size += len(data)
        if paused or size >= CHUNK:
            text = b"".join(held)
            cut = text.rfind(b"\n") + 1
            if cut:
                yield text[:cut]
            held = [text[cut:]] if cut < len(text) else []
            size = len(text) - cut if cut else 0  # a line that has no end yet waits for more
    if held:
        yield b"".join(held)


def stdin_commits(spark: SparkSession, corpus: Corpus, *, scheme_less: bool = True) -> Iterator[Commit]:
    """Commits standard input chunk by chunk; a chunk's text lies in the shared folder, where executors see it, until it is committed."""
    at = Folder(spark, shared_dir(spark))
    for chunk in stdin_chunks():
        name = f"stdin-{uuid.uuid4().hex}.txt"
        at.write(chunk, name)
        try:
            yield corpus.append(read_log(spark, f"{at.path}/{name}", scheme_less=scheme_less, file=True))
        finally:
            at.delete(name)


def _of(corpus: Corpus, commit: Commit) -> DataFrame:
    return corpus.log(since=commit.number - 1, upto=commit.number)


def lines(spark: SparkSession, a: argparse.Namespace) -> Iterator[str]:
    """The lines that a command prints."""
    path = corpus_path(a.corpus, without=a.no_corpus)
    if a.reset:
        path = corpus_path(a.corpus)
        open_corpus(spark, path).reset()
        yield f"reset corpus at {path}"
        return
    args = list(a.input)
    if len(args) == 2 and args[0] in TABLES:
        yield from _table_lines(TABLES[args[0]](read_log(spark, args[1], scheme_less=not a.no_scheme_less)))
        return
    listed = args[:1] == ["cluster"]
    args = args[listed:]
    corpus = open_corpus(spark, path, strategy=a.host) if path else None
    report = a.stats or a.reinfer or a.propose_recognizers or a.cross_host_shapes
    if report and not args:
        if corpus is None:
            raise Failure("missing argument <--corpus>")
        if a.reinfer:
            n, before = corpus.log().count(), corpus.observed().urls.select("cluster_key").distinct().count() if not corpus.version() else corpus.view("clusters").count()
            corpus.reinfer()
            after = corpus.view("clusters").count()
            yield f"reinferred {n} observation{'s' * (n != 1)}: {before} → {after} cluster{'s' * (after != 1)}"
        elif a.propose_recognizers:
            yield from _proposal_lines(corpus, a)
        else:
            yield from (_stats_lines if a.stats else _shared_lines)(corpus.observed(), a)
        corpus.close()
        return
    source = args[0] if args else "-"
    scratch = Corpus(spark, f"{shared_dir(spark)}/stdin-{uuid.uuid4().hex}", strategy=a.host) if source == "-" and corpus is None else None
    try:
        yield from (_stdin_lines(spark, a, corpus, corpus or scratch, listed) if source == "-" else _source_lines(spark, a, corpus, source, listed))
    finally:
        if scratch is not None:
            scratch.reset()
    if corpus is not None:
        corpus.close()


def _whole_lines(log: DataFrame, o: Observed, a: argparse.Namespace, listed: bool) -> Iterator[str]:
    if a.stats:
        yield from _stats_lines(o, a)
    elif listed or log.limit(LARGE).count() >= LARGE:
        yield from _cluster_lines(o, a)
    else:
        yield from _list_lines(log, a)


def _stdin_lines(spark: SparkSession, a: argparse.Namespace, corpus: Corpus | None, to: Corpus, listed: bool) -> Iterator[str]:
    names, array, first, before = list(dict.fromkeys(a.sections or [])), a.json and not a.ndjson, True, to.last_commit().number
    for commit in stdin_commits(spark, to, scheme_less=not a.no_scheme_less):
        if not names:
            continue
        # Rendered once committed; with a corpus each URL as the corpus stood when it had arrived.
        informed = kept(to.normalized_at(commit, hints=not a.no_hints), "informed") if corpus is not None and "normalize" in names else None
        shown = sections(_of(to, commit), names, hints=not a.no_hints, informed=informed)
        for line in _section_lines(shown, names, a, False):
            if array:  # one array over all chunks
                line = line.removesuffix("]") if line in ("]", "[]") else line
                line = ("," if not first and line.startswith("[") else "") + (line[1:] if not first and line.startswith("[") else line)
                if line in ("", ","):
                    continue
                first = False
            yield line
    if names:
        if array:
            yield "[]" if first else "]"
        return
    log = to.log(since=before)
    yield from _whole_lines(log, to.observed(), a, listed)


def _source_lines(spark: SparkSession, a: argparse.Namespace, corpus: Corpus | None, source: str, listed: bool) -> Iterator[str]:
    single = "://" in source or not os.path.exists(source)
    if single and (listed or source.startswith(("/", "./", "../"))):
        raise Failure(f"no such file: {source}")
    log = read_log(spark, source, scheme_less=not a.no_scheme_less)
    if single and parse_urls(log).where("iri.error is null").isEmpty():
        raise Failure(f"cannot parse: {source}", 2)
    if corpus is not None:
        log = kept(_of(corpus, corpus.append(log)), "log")
    if a.sections or single:
        names = list(dict.fromkeys(a.sections or ["parse", "normalize"]))
        informed = None
        if corpus is not None and "normalize" in names:
            corpus.refresh()
            informed = corpus.normalized(observe(log, strategy=a.host, activations=corpus.activations(), keep=True), hints=not a.no_hints)
        yield from _section_lines(sections(log, names, hints=not a.no_hints, informed=informed), names, a, single)
    else:
        yield from _whole_lines(log, corpus.observed() if corpus is not None else observe(log, strategy=a.host, keep=True), a, listed)


def main(args: list[str] | None = None) -> None:
    try:
        a = parser().parse_args(args)
    except SystemExit as e:
        raise SystemExit(1 if e.code else 0) from None  # 2 is for input that is no URL
    spark = SparkSession.builder.appName("pathloom").getOrCreate()
    try:
        for line in lines(spark, a):
            print(line, flush=True)
    except BrokenPipeError:
        sys.stdout = open(os.devnull, "w")  # nothing is written to the closed pipe at exit
        raise SystemExit(141) from None
    except Failure as e:
        code = "parse_error" if e.code == 2 else "file_not_found" if str(e).startswith("no such file") else "option_error"
        print(json.dumps({"error": {"code": code, "message": str(e)}}) if a.json or a.ndjson else f"pathloom: {e}", file=sys.stderr)
        raise SystemExit(e.code) from None


if __name__ == "__main__":
    main()
