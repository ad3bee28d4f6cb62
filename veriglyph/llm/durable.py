"""Tables that outlive executors, and components over tables of links."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ready(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder that spark.checkpoint.dir names. Only on one machine may none be named: a temporary one is taken."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veriglyph-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from reliable storage instead of computed again."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*tables: DataFrame) -> None:
    """Delete the checkpoints of tables made by ``cut`` that nothing will read again."""
    for df in tables:
        context = df.sparkSession.sparkContext
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = context._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let the driver find which shuffles no table needs any more, now that their results are cut: Spark's cleaner then drops their files.

    Python's handles of tables lie in cycles and hold the JVM's tables until Python has collected its garbage and py4j has told
    the JVM so. It does that in a thread that sleeps for a second whenever it finds nothing to tell, so what waits is told here.
    """
    gc.collect()
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while waiting:
        try:
            task = waiting.pop()
        except IndexError:  # the thread was faster
            break
        if not isinstance(task, tuple):  # the thread is to end
            waiting.append(task)
            break
        task[0].garbage_collect_object(task[1], False)
    spark.sparkContext._jvm.System.gc()


def components(links: DataFrame) -> DataFrame:
    """(node, component): of (a, b) links, each linked node's smallest reachable node.

    Each round every node takes the smallest label around it and then that label's own label, so rounds grow with
    the logarithm of a component's width. Labels are tables; the driver sees one count a round.
    """
    links = links.filter("a <> b").selectExpr("a", "b")
    both = cut(links.union(links.selectExpr("b as a", "a as b")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as node", "least(a, m) as component"))
    held = [labels]
    while True:
        near = both.join(labels.selectExpr("node as b", "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near.selectExpr("a as node", "m"), "node").selectExpr("node", "component as was", "least(component, m) as component")
        jump = labels.selectExpr("node as component", "component as beyond")
        new = cut(lower.join(jump, "component", "left").selectExpr("node", "was", "least(component, coalesce(beyond, component)) as component"))
        lower = new.filter("component < was").count()
        forget(*held)
        labels, held = new.select("node", "component"), [new]
        if not lower:
            forget(both)
            return labels
        tidy(labels.sparkSession)
