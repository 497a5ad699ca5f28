"""Relations between the files of a document as they arrive: calls, module references and dependencies, with state kept by document.

What one file says is taken from its row by the operators of a batch; a document's state holds that of each of its files, never their
texts. When no file of a document has come for a while its relations are emitted, with a version; a file that comes later, or anew, starts
the wait again and gives the next version. A version replaces those before it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import source_code as S
from .sources import arriving_sources

RESULT = "doc_id string, version int, relation string, file_name string, source string, target string"


def file_facts(files: DataFrame) -> DataFrame:
    """(doc_id, name, facts) of source files: procedures with the words of their bodies, the words of all, and dependencies, as JSON.

    Files of one folder are one document.
    """
    procs = S._procedure_parts(files).select("doc_id", F.col("file_name").alias("name"), "lines", "procs")
    body = lambda p: F.array_join(F.slice("lines", p["line"], F.coalesce(p["line_end"], p["line"] + S.OPEN_BODY) - p["line"] + 1), "\n")
    said = F.transform("procs", lambda p: F.struct(F.get(p["parts"], F.lit(2)).alias("name"), S.tokens(body(p)).alias("words")))
    text = F.array_join("lines", "\n")
    found = F.array_distinct(F.transform(S.rule_matches(text), lambda d: F.struct(d["category"].alias("category"), d["value"].alias("value"))))
    return procs.select("doc_id", "name", F.to_json(F.struct(said.alias("procedures"), S.tokens(text).alias("words"), found.alias("dependencies"))).alias("facts"))


def relations(files: dict[str, dict]) -> list[tuple[str, str, str, str]]:
    """(relation, file, source, target) of a document's files: name -> facts. The same rows as ``calls``, ``module_references`` (of names that are one identifier) and ``dependencies`` give."""
    callees: dict[str, set[str]] = {}
    for facts in files.values():
        for p in facts["procedures"]:
            callees.setdefault(p["name"].lower(), set()).add(p["name"])
    modules: dict[str, set[str]] = {}
    for name in files:
        module = name.rsplit(".", 1)[0]
        modules.setdefault(module.lower(), set()).add(module)
    out = set()
    for name, facts in files.items():
        own = name.rsplit(".", 1)[0]
        for p in facts["procedures"]:
            out |= {("call", name, p["name"], c) for w in p["words"] for c in callees.get(w, ()) if c != p["name"]}
        out |= {("reference", name, own, m) for w in facts["words"] for m in modules.get(w, ()) if m != own}
        out |= {("dependency", name, d["category"], d["value"]) for d in facts["dependencies"]}
    return sorted(out)


class Relations(StatefulProcessor):
    """State of a document: what each file says, the timer that runs, and the version that came last."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "name string", "facts string")
        self.meta = handle.getValueState("meta", "timer long, version int")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for name, facts in zip(frame["name"], frame["facts"], strict=True):
                self.files.updateValue((name,), (facts,))
        timer, version = self.meta.get() if self.meta.exists() else (0, 0)
        if timer:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.quiet
        self.handle.registerTimer(timer)
        self.meta.update((timer, version))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        version = (self.meta.get() or (0, 0))[1] + 1
        self.meta.update((0, version))
        found = relations({name: json.loads(facts) for (name,), (facts,) in self.files.iterator()})
        # a document without relations gives one row of nulls, so that an earlier version is replaced too
        rows = [(key[0], version, *r) for r in found] or [(key[0], version, None, None, None, None)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    def close(self) -> None:
        pass


def arriving_relations(spark: SparkSession, path: str, quiet: float = 60.0, at_once: int = 1000) -> DataFrame:
    """A stream of (doc_id, version, relation, file_name, source, target) for the folders of source files below ``path``.

    ``quiet``: seconds without a new file after which a document's relations are emitted. Needs state in RocksDB, which is set here,
    and a checkpoint folder of the query that all executors share.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    files = arriving_sources(spark, path, at_once)
    folder = F.regexp_replace("source_path", "/[^/]*$", "")
    facts = file_facts(files.withColumn("doc_id", F.sha2(folder, 256)))
    return facts.groupBy("doc_id").transformWithStateInPandas(Relations(int(quiet * 1000)), outputStructType=RESULT, outputMode="Update", timeMode="ProcessingTime")
