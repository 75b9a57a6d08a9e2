"""A corpus kept in a directory: an append-only log, activations, versioned views and the state of running evidence.

    log/part=P/          (n, url): canonical forms of one append in the order of arrival
    commits/N            says which part is the N-th, and the obs_id it starts with
    activations/         (prefix, type)
    views/V/NAME/        the materialised views
    views/V/known_NAME/  the evidence that follows from them, in buckets by position or cluster, sorted by key
    current/N            says which views are version N, and what commit they hold
    states/S/TABLE/      what running evidence knows of slots that some commits touched
    running/N            says which of these make up the state after commit N

What a process writes counts once a small file names it. Such a file is created
whole, under the next number, and creation fails if that number is taken; then
the next one is tried. So any number of processes may append, read and compute
views of one corpus at a time: the commits give them one order, a reader sees
those up to the last one when it began, and what is never named is never read.

``open_corpus`` also takes a ``.json`` file: the nine keys of a dump, read into
a directory in the shared folder and written back by ``close``.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.urls import parse_urls
from ..functions.values import Activation
from ..operators.infer import Evidence, evidence_of, ladder, undecided
from ..operators.learn import activate_above
from ..operators.render import carried_normalize, corpus_normalize
from ..operators.running import STATE_KEYS, RunningState, merged_state
from ..operators.views import MERGES, PARAM, POSITION, VIEWS, Observed, all_views, merged_view, observe
from . import dump
from .files import Folder
from .tables import discard, kept, ranked, scratch, shared_dir

_COMMIT = "number long, part string, first long, n long, writer string, batch long"
#: The list of so many commits is broadcast (some 10 MB); a longer one is joined by shuffle.
MOST_BROADCAST = 100_000
#: A state is made of so many parts at most, then they are written as one.
MOST_PARTS = 8


#: Evidence is cut into so many buckets at most, and into one for so many tracked values.
BUCKETS, BUCKET_VALUES = 4096, 50_000


def _bucket(keys: list[str], buckets: int) -> Column:
    # Values share the bucket of their position, parameters that of their cluster.
    return F.pmod(F.xxhash64(*[k for k in keys if k not in ("value", "name")]), F.lit(buckets)).cast("int")


def _keyed(known: Evidence) -> dict[str, tuple[DataFrame, list[str]]]:
    return {"positions": (known.positions, POSITION), "values": (known.values, [*POSITION, "value"]), "params": (known.params, PARAM)}


class Commit(NamedTuple):
    """The ``number``-th append: its observations are ``first`` to ``first + n - 1``."""

    number: int
    first: int
    n: int


class Corpus:
    """A handle on a corpus directory, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, *, strategy: str = "full"):
        self.spark, self.path, self.strategy = spark, path.rstrip("/"), strategy
        self.folder = Folder(spark, self.path)

    def _last(self) -> dict:
        """The last commit; before the first one, a commit of nothing."""
        names = self.folder.names("commits")
        return json.loads(self.folder.read("commits", names[-1])) if names else {"number": 0, "first": 1, "n": 0, "writers": {}}

    def last_commit(self) -> Commit:
        last = self._last()
        return Commit(last["number"], last["first"], last["n"])

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(_COMMIT).json(f"{self.path}/commits")

    def append(self, log: DataFrame, batch: int | None = None, *, writer: str = "") -> Commit:
        """Adds the URLs of ``log`` that parse, in the order of its obs_id, after all that the corpus holds; the store numbers them.

        A writer that may repeat itself gives its own name and numbers its batches
        upwards: one that is there already is not added again, and its commit is given.
        """
        def there(last: dict) -> Commit | None:
            if batch is None or batch > last["writers"].get(writer, -1):
                return None
            found = self._commits().where((F.col("writer") == writer) & (F.col("batch") == batch)).first()
            if found is None:
                raise ValueError(f"writer {writer!r} is beyond batch {batch}, which it left out")
            return Commit(found["number"], found["first"], found["n"])

        if done := there(self._last()):
            return done
        parsed = parse_urls(log.select("obs_id", "url")).where("iri.error is null").select("obs_id", F.col("iri.canonical").alias("url"))
        rows, n, held = ranked(parsed, "n", "obs_id", first=0)
        part = uuid.uuid4().hex
        if n:
            rows.select("n", "url").write.parquet(f"{self.path}/log/part={part}")
        discard(held)
        while True:
            last = self._last()
            if done := there(last):
                self.folder.delete("log", f"part={part}")
                return done
            made = {"number": last["number"] + 1, "part": part, "first": last["first"] + last["n"], "n": n, "writer": writer, "batch": batch, "writers": {**last["writers"], **({writer: batch} if batch is not None else {})}}
            if self.folder.create(json.dumps(made), "commits", f"{made['number']:019d}"):
                return Commit(made["number"], made["first"], n)

    def log(self, after: int | None = None, *, since: int = 0, upto: int | None = None) -> DataFrame:
        """(obs_id, url) of the log as it stands, or of what came after an observation, or of the commits after ``since`` and up to ``upto``."""
        last = self.last_commit()
        upto = last.number if upto is None else upto
        if upto <= since:
            return self.spark.createDataFrame([], "obs_id long, url string")
        commits = self._commits().where((F.col("n") > 0) & (F.col("number") > since) & (F.col("number") <= upto))
        if after is not None:
            commits = commits.where(F.col("first") + F.col("n") > after + 1)
        if not self.folder.has("log"):  # commits of nothing alone
            return self.spark.createDataFrame([], "obs_id long, url string")
        # Parts are folders, so those of other commits are not read.
        commits = commits.select("part", "first")
        rows = self.spark.read.schema("n long, url string, part string").parquet(f"{self.path}/log")
        rows = rows.join(F.broadcast(commits) if upto <= MOST_BROADCAST else commits, "part").select((F.col("first") + F.col("n")).alias("obs_id"), "url")
        return rows if after is None else rows.where(F.col("obs_id") > after)

    def activations(self) -> list[Activation]:
        if not self.folder.has("activations"):
            return []
        rows = self.spark.read.parquet(f"{self.path}/activations").select("prefix", "type").distinct().orderBy("prefix", "type").collect()
        return [(r["prefix"], r["type"]) for r in rows]

    def observed(self, *, keep: bool = True, since: int = 0, upto: int | None = None) -> Observed:
        return observe(self.log(since=since, upto=upto), strategy=self.strategy, activations=self.activations(), keep=keep)

    def _about(self) -> list:
        """What a view or state depends on besides the log."""
        return [self.strategy, *map(list, self.activations())]

    def _current(self) -> dict:
        names = self.folder.names("current")
        return {"version": int(names[-1]), **json.loads(self.folder.read("current", names[-1]))} if names else {"version": 0, "commit": 0, "about": None}

    def version(self) -> int:
        """The highest version of views; 0 without one."""
        return self._current()["version"]

    def _publish(self, views: dict[str, DataFrame], commit: int, about: list) -> int:
        """Writes views and makes them the next version, unless a later commit's are there."""
        name = uuid.uuid4().hex
        for view, df in views.items():
            df.write.parquet(f"{self.path}/views/{name}/{view}")
        known = evidence_of({k: self.spark.read.parquet(f"{self.path}/views/{name}/{k}") for k in VIEWS})
        buckets = max(1, min(BUCKETS, known.values.count() // BUCKET_VALUES))
        for table, (df, keys) in _keyed(known).items():
            placed = df.withColumn("bucket", _bucket(keys, buckets))
            placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", *keys).write.partitionBy("bucket").parquet(f"{self.path}/views/{name}/known_{table}")
        while True:
            now = self._current()
            if now["commit"] > commit and now["about"] == about:
                self.folder.delete("views", name)
                return now["version"]
            version = now["version"] + 1
            if self.folder.create(json.dumps({"views": name, "commit": commit, "about": about, "buckets": buckets}), "current", f"{version:019d}"):
                break
        # The version before stays for readers that have begun.
        for old in self.folder.names("current")[:-2]:
            gone = json.loads(self.folder.read("current", old))["views"]
            self.folder.delete("current", old)
            self.folder.delete("views", gone)
        return version

    def reinfer(self, of: Observed | None = None, upto: int | None = None) -> int:
        """Computes all views from the log and makes them current; gives their version.

        ``of`` is what ``observed`` gave of all commits up to ``upto``, for a caller who has it: then the log isn't parsed again.
        """
        if (of is None) != (upto is None):
            raise ValueError("of and upto go together")
        commit, about = self.last_commit().number if upto is None else upto, self._about()
        with scratch():
            return self._publish(all_views(self.observed(upto=commit) if of is None else of), commit, about)

    def refresh(self) -> int:
        """Brings the views up to the last commit: those of the commits since the current version are merged into it.

        What a view takes from its table alone is merged; views that were added to
        VIEWS, and all where strategy or activations have changed, are computed anew.
        """
        now, commit, about = self._current(), self.last_commit().number, self._about()
        if now["about"] != about or not self._views_of(now):
            return self.reinfer()
        if now["commit"] == commit:
            return now["version"]
        with scratch():
            later = all_views(self.observed(since=now["commit"], upto=commit), capped=False)
            whole = self.observed(upto=commit) if set(VIEWS) - set(MERGES) else None
            views = {k: merged_view(k, self.spark.read.parquet(f"{self.path}/views/{now['views']}/{k}"), later[k]) if k in MERGES else VIEWS[k](whole) for k in VIEWS}
            return self._publish(views, commit, about)

    def _views_of(self, now: dict) -> bool:
        """Whether a version has all views."""
        return bool(now["version"]) and set(VIEWS) <= set(self.folder.names("views", now["views"]))

    def view(self, name: str) -> DataFrame:
        """A view of the current version."""
        if name not in VIEWS:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/views/{self._current()['views']}/{name}")

    def known_of(self, of: Observed) -> Evidence:
        """What the current views know of the slots of ``of``: only the buckets that hold these are read."""
        now = self._current()
        if not now["version"]:
            raise ValueError("the corpus has no views yet")
        out = []
        # Evidence of nothing has no bucket that would tell its columns: they are those that would be made now.
        kinds = evidence_of({k: self.spark.read.parquet(f"{self.path}/views/{now['views']}/{k}") for k in VIEWS})
        # Slots are asked for once, then looked up.
        slots = {tuple(keys): kept(asked.select(*keys).distinct(), "wanted") for asked, keys in ((of.segments, POSITION), (of.params, PARAM))}
        for table, keys in (("positions", POSITION), ("values", POSITION), ("params", PARAM)):
            wanted = slots[tuple(keys)]
            at = [r[0] for r in wanted.select(_bucket(keys, now["buckets"]).alias("b")).distinct().collect()]  # BUCKETS at most
            schema = StructType([*getattr(kinds, table).schema, StructField("bucket", IntegerType())])
            df = self.spark.read.schema(schema).parquet(f"{self.path}/views/{now['views']}/known_{table}").where(F.col("bucket").isin(at)).drop("bucket")
            out.append(df.join(wanted, keys, "left_semi"))
        return Evidence(*out)

    def normalized(self, of: Observed, *, hints: bool = True) -> DataFrame:
        """(obs_id, normalized) of the URLs of ``of`` by the current views."""
        asked = of._replace(segments=of.segments.where(undecided(F.col("type"))))
        return corpus_normalize(self.known_of(asked), of, hints=hints)

    def params_for(self, of: Observed) -> DataFrame:
        """(cluster_key, name, type, total, cardinality) of the parameters that the URLs of ``of`` have, by the current views."""
        return self.known_of(of).params.select(*PARAM, ladder(F.col("name")).alias("type"), "total", "cardinality")

    def _state(self, parts: list[str]) -> RunningState | None:
        """The state that parts make up: of each key what the last part says."""
        if not parts:
            return None
        out = []
        for name, keys in STATE_KEYS.items():
            every = [self.spark.read.parquet(f"{self.path}/states/{p}/{name}").withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
            df = every[0]
            for more in every[1:]:
                df = df.unionByName(more)
            others = [c for c in df.columns if c not in (*keys, "_part")]
            if len(parts) > 1:
                df = df.groupBy(*keys).agg(F.max_by(F.struct(*others), "_part").alias("_s")).select(*keys, *(F.col("_s")[c].alias(c) for c in others))
            out.append(df.select(*keys, *others))
        return RunningState(*out)

    def normalized_at(self, commit: Commit, *, hints: bool = True) -> DataFrame:
        """(obs_id, normalized) of a commit's URLs, each by the corpus as it stood when it had just been observed.

        Evidence is carried on from the last state that was stored before the
        commit, through what other writers have committed since, and stored again
        under the commit's number: the cost is that of the new observations and of
        the slots that they touch, not of the log. Where strategy or activations have
        changed there is no such state, and the log is read from its beginning.
        """
        about = self._about()
        base: dict = {"number": 0, "parts": [], "old": []}
        for name in reversed(self.folder.names("running")):
            found = json.loads(self.folder.read("running", name))
            if int(name) < commit.number and found["about"] == about:
                base = {"number": int(name), **found}
                break
        state = self._state(base["parts"])
        out, touched = carried_normalize(self.observed(since=base["number"], upto=commit.number), state, hints=hints)
        name = uuid.uuid4().hex
        whole = len(base["parts"]) + 1 > MOST_PARTS
        for table, df in zip(STATE_KEYS, merged_state(state, touched) if whole else touched, strict=True):
            df.write.parquet(f"{self.path}/states/{name}/{table}")
        made = {"parts": [name] if whole else [*base["parts"], name], "old": base["parts"] if whole else base["old"], "about": about}
        if self.folder.create(json.dumps(made), "running", f"{commit.number:019d}") and whole:
            for old in base["old"]:  # of the last but one that was written as one
                self.folder.delete("states", old)
            for n in self.folder.names("running"):
                if int(n) < commit.number - 4 * MOST_PARTS:
                    self.folder.delete("running", n)
        return out.where(F.col("obs_id").between(commit.first, commit.first + commit.n - 1))

    def activate_above(self, least: float) -> list[Activation]:
        """Activates proposals of at least that confidence and recomputes the views."""
        held = self.activations()
        now, _ = activate_above(self.log(), least, held=held, strategy=self.strategy)
        if new := now[len(held) :]:
            self._activate(new)
        self.reinfer()
        return now

    def save_json(self, file: str) -> None:
        """Writes the corpus into one JSON file of nine keys, as ``dump`` does it."""
        commit = self.last_commit().number
        with scratch():
            dump.save(file, self.observed(upto=commit), self.log(upto=commit), self.activations())

    def load_json(self, file: str) -> None:
        """Takes the log and the activations of a JSON file into this corpus, which must be empty; all else follows from them."""
        if self.last_commit().number or self.folder.has("activations"):
            raise ValueError("the corpus is not empty")
        log, activations = dump.load(self.spark, file)
        self.append(log)
        if activations:
            self._activate(activations)

    def _activate(self, new: list[Activation]) -> None:
        self.spark.createDataFrame(new, "prefix string, type string").write.mode("append").parquet(f"{self.path}/activations")

    def reset(self) -> None:
        """Deletes the corpus."""
        self.folder.delete()

    def close(self) -> None:
        """A directory has nothing to write at the end."""


class JsonCorpus(Corpus):
    """A corpus in one JSON file, in the shared folder while it is open; ``close`` writes it back."""

    def __init__(self, spark: SparkSession, file: str, *, strategy: str = "full"):
        super().__init__(spark, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", strategy=strategy)
        self.file = file
        if os.path.exists(file):
            self.load_json(file)

    def close(self) -> None:
        self.save_json(self.file)
        super().reset()

    def reset(self) -> None:
        super().reset()
        if os.path.exists(self.file):
            os.remove(self.file)


def open_corpus(spark: SparkSession, path: str, *, strategy: str = "full") -> Corpus:
    """The extension picks the form: ``.json`` is one file, all else a directory."""
    return JsonCorpus(spark, path, strategy=strategy) if path.endswith(".json") else Corpus(spark, path, strategy=strategy)


def corpus_path(given: str = "", *, without: bool = False) -> str | None:
    """Where the corpus is: as given, none if unwanted, PATHLOOM_CORPUS, or the user's data directory. PATHLOOM_NO_CORPUS=1 unwants the last two."""
    if given:
        return given
    if without or os.environ.get("PATHLOOM_NO_CORPUS", "").lower() not in ("", "0", "false", "no"):
        return None
    if path := os.environ.get("PATHLOOM_CORPUS"):
        return path
    base = os.environ.get("XDG_DATA_HOME") or os.path.join(os.path.expanduser("~"), ".local", "share")
    return os.path.join(base, "pathloom", "default")
