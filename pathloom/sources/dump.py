"""A corpus as one JSON file of nine keys, made of ordered fragments that tasks write and the file system joins.

Whatever the size of the corpus, the driver passes bytes on and holds none of
them: each fragment is a row, sorted over all tasks. Each observed URL has a
line of its own, so a file that was written here is read back by all tasks too.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.values import Activation
from ..operators.views import PARAM, POSITION, VIEWS, Observed, counted, first_come, numeric_stats
from .files import Folder
from .logs import text_file
from .tables import kept, shared_dir

_OPEN, _CLOSE = '"observed_iris":[', "],"


def _string(c: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(?s:(.*))\}\z', 1)


def _object(entries: Column) -> Column:
    """A JSON object of the (value, n) entries, in their order."""
    return F.to_json(F.map_from_entries(entries))


def _counts(view: DataFrame, key: str) -> tuple[DataFrame, list]:
    return view.select(F.col("n"), F.col(key).cast("string").alias("k"), F.concat(F.lit(","), _string(F.col(key).cast("string")), F.lit(":"), F.col("n").cast("string")).alias("text")), [F.desc("n"), "k"]


def _slots(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_obs, stats): the statistics of each slot as JSON; its values are those that are tracked, so a row is bounded."""
    c = kept(counted(df, keys), "slots")
    entry = F.struct("first_obs", F.struct(F.col("value").alias("value"), "n").alias("e"))
    values = first_come(c, keys, L.VALUE_CAP).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("values"))
    types = c.groupBy(*keys, "type").agg(F.sum("n").alias("n"), F.min("first_obs").alias("first_obs"))
    entry = F.struct("first_obs", F.struct(F.col("type").alias("value"), "n").alias("e"))
    types = types.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("types"), F.sum("n").alias("total"), F.min("first_obs").alias("first_obs"))
    numbers = numeric_stats(c, keys)
    s = values.join(types, keys).join(numbers, keys, "left")
    number = F.when(F.col("num_count").isNotNull(), F.concat(F.lit(","), F.regexp_extract(F.to_json(F.struct(F.col("num_count").alias("numeric_count"), F.col("num_min").alias("numeric_min"), F.col("num_max").alias("numeric_max"), F.col("num_sum").alias("numeric_sum"))), r"^\{(.*)\}\z", 1))).otherwise("")
    stats = F.concat(F.lit('{"value_counts":'), _object(F.col("values")), F.lit(',"type_counts":'), _object(F.col("types")), F.lit(',"total":'), F.col("total").cast("string"), F.lit(f',"max_values":{L.VALUE_CAP}'), number, F.lit("}"))
    return s.select(*keys, "first_obs", stats.alias("stats"))


def _clusters(o: Observed) -> tuple[DataFrame, list]:
    """The fragments of all clusters: of each its beginning, its segment counts position by position, its parameters.

    A position's first value comes with its beginning, the others are rows of
    their own, so that no row holds a hot position.
    """
    def at(df: DataFrame, part: int, pos: Column, step: int, m: Column, value: Column, text: Column) -> DataFrame:
        return df.select("ord", F.lit(part).alias("part"), pos.cast("long").alias("pos"), F.lit(step).alias("step"), m.cast("long").alias("m"), value.cast("string").alias("value"), text.alias("text"))

    none, zero = F.lit(None), F.lit(0)
    examples = VIEWS["cluster_examples"](o).groupBy("cluster_key").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("first_obs", "canonical"))), lambda x: x["canonical"])).alias("examples"))
    c = kept(VIEWS["clusters"](o).join(examples, "cluster_key"), "dumped")
    head = F.regexp_extract(F.to_json(F.struct(F.col("cluster_key").alias("key"), "host", "scheme", "shape", F.col("n").alias("count"))), r"^(?s:(.*))\}\z", 1)
    out = at(c, 0, zero, 0, zero, none, F.concat(F.lit(","), _string(F.col("cluster_key")), F.lit(":"), head, F.lit(',"examples":'), F.col("examples"), F.lit(',"segment_counts":[')))
    s = VIEWS["cluster_segments"](o)
    ends = s.groupBy("cluster_key", "pos").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("first"))
    s = kept(s.join(ends, ["cluster_key", "pos"]).join(c.select("cluster_key", "ord"), "cluster_key"), "dumped_segments")
    pair = F.concat(_string(F.col("value")), F.lit(":"), F.col("n").cast("string"))
    first = (F.col("value") == F.col("first.value")) & (-F.col("n") == F.col("first.m"))
    out = out.union(at(s.where(first), 1, F.col("pos"), 0, zero, none, F.concat(F.when(F.col("pos") > 0, ",{").otherwise("{"), pair)))
    out = out.union(at(s.where(~first), 1, F.col("pos"), 1, -F.col("n"), F.col("value"), F.concat(F.lit(","), pair)))
    out = out.union(at(s.where(first), 1, F.col("pos"), 2, zero, none, F.lit("}")))
    p = kept(_slots(o.params, PARAM).join(c.select("cluster_key", "ord"), "cluster_key"), "dumped_params")
    low = p.groupBy("ord").agg(F.min("first_obs").alias("low"))
    p = p.join(low, "ord")
    out = out.union(at(c, 2, zero, 0, zero, none, F.lit('],"param_stats":{')))
    # Parameters of one URL share its number: their names part them.
    lowest = p.where("first_obs = low").groupBy("ord").agg(F.min("name").alias("first"))
    p = p.join(lowest, "ord")
    comma = F.when((F.col("first_obs") == F.col("low")) & (F.col("name") == F.col("first")), "").otherwise(",")
    out = out.union(at(p, 3, zero, 0, F.col("first_obs"), F.col("name"), F.concat(comma, _string(F.col("name")), F.lit(":"), F.col("stats"))))
    return out.union(at(c, 4, zero, 0, zero, none, F.lit("}}"))), ["ord", "part", "pos", "step", "m", "value"]


def _pieces(o: Observed, log: DataFrame, activations: list[Activation]) -> Iterator[tuple[str, tuple[DataFrame, list] | None]]:
    """The file in order: texts, and after each the fragments that follow, each beginning with a comma that the first one goes without."""
    for name, key in (("host_counts", "host"), ("path_length_counts", "length"), ("raw_shape_counts", "raw_shape"), ("fingerprint_counts", "shape")):
        yield ("{" if name == "host_counts" else "},") + f'\n"{name}":{{', _counts(VIEWS[name](o), key)
    position = F.to_json(F.struct(*POSITION))
    slots = _slots(o.segments, POSITION).select("first_obs", *POSITION, F.concat(F.lit(',{"position":'), position, F.lit(',"stats":'), F.col("stats"), F.lit("}")).alias("text"))
    yield f'}},\n"max_values_per_position":{L.VALUE_CAP},\n"position_stats":[', (slots, ["first_obs", *POSITION])
    yield '],\n"clusterer":{"clusters":{', _clusters(o)
    yield f"}}}},\n{_OPEN}\n", (log.select("obs_id", F.concat(F.lit(","), _string(F.col("url"))).alias("text")), ["obs_id"])
    yield f"\n{_CLOSE}\n" + '"activated_recognizers":' + json.dumps([{"prefix": p, "type": t} for p, t in activations]) + "}\n", None


def save(file: str, o: Observed, log: DataFrame, activations: list[Activation]) -> None:
    """Writes the file under another name, then renames it."""
    spark = log.sparkSession
    shared = Folder(spark, shared_dir(spark))
    new = f"{file}.{uuid.uuid4().hex}.tmp"
    with open(new, "wb") as out:
        for text, fragments in _pieces(o, log, activations):
            out.write(text.encode())
            if fragments is None:
                continue
            df, order = fragments
            name = f"dump-{uuid.uuid4().hex}"
            df.orderBy(*order).select("text").write.text(f"{shared.path}/{name}")
            first = True
            for part in shared.names(name):
                for block in shared.blocks(name, part):
                    out.write(block[1:] if first else block)  # without the first comma
                    first = False
            shared.delete(name)
    os.replace(new, file)


def load(spark: SparkSession, file: str) -> tuple[DataFrame, list[Activation]]:
    """(log, activations) of a file. One that was not written here, whose URLs have no lines of their own, is read by the driver."""
    shared, name = Folder(spark, shared_dir(spark)), f"load-{uuid.uuid4().hex}.json"
    with open(file, "rb") as f:
        shared.write_blocks(iter(lambda: f.read(1 << 20), b""), name)
    lines = text_file(spark, f"{shared.path}/{name}")
    edges = {r["text"]: r["line_id"] for r in lines.where(F.col("text").isin(_OPEN, _CLOSE)).orderBy("line_id").limit(3).collect()}
    if set(edges) != {_OPEN, _CLOSE}:
        from .logs import literal_log

        with open(file, encoding="utf-8") as f:
            found = json.load(f)
        return literal_log(spark, found["observed_iris"]), [(x["prefix"], x["type"]) for x in found.get("activated_recognizers") or []]
    inside = lines.where((F.col("line_id") > edges[_OPEN]) & (F.col("line_id") < edges[_CLOSE]) & (F.col("text") != ""))
    url = F.from_json(F.concat(F.lit('{"v":'), F.regexp_replace("text", "^,", ""), F.lit("}")), "v string")["v"]
    last = lines.where(F.col("line_id") > edges[_CLOSE]).orderBy("line_id").limit(1).first()["text"]
    given = json.loads("{" + last)["activated_recognizers"]
    return inside.select(F.col("line_id").alias("obs_id"), url.alias("url")), [(x["prefix"], x["type"]) for x in given]
