"""Repeatable changes of stored partitions: rows are staged, then files are renamed in and old ones removed.

A change is one folder: ``rows`` (the new files) and ``plan`` (which files come and which go). The
plan is written last, under its final name by a rename. Whatever dies, running the change again
with the same folder does what is left of it, and nothing twice: before the plan it starts anew,
after it only names change. Files that others add in between are never touched.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession


class Files:
    """The few file system calls needed, through Spark's own file systems."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self.at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[str]:
        """Names directly below a folder, without hidden ones; none if it is not there."""
        p, fs = self.at(path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if not n.startswith(("_", ".")))

    def below(self, path: str) -> list[str]:
        """Files of a folder of partitions, as paths relative to it."""
        p, fs = self.at(path)
        if not fs.exists(p):
            return []
        out, it, root = [], fs.listFiles(p, True), fs.makeQualified(p).toString().rstrip("/") + "/"
        while it.hasNext():
            name = it.next().getPath().toString()[len(root) :]
            if not any(x.startswith(("_", ".")) for x in name.split("/")):
                out.append(name)
        return sorted(out)

    def rename(self, old: str, new: str) -> bool:
        """False if the new name is taken or the old one is gone."""
        (a, fs), (b, _) = self.at(old), self.at(new)
        if fs.exists(b) or not fs.exists(a):
            return False
        fs.mkdirs(b.getParent())
        return fs.rename(a, b)

    def delete(self, path: str) -> None:
        p, fs = self.at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def write(self, path: str, text: str) -> None:
        p, fs = self.at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()


def change(spark: SparkSession, folder: str, path: str, write: Callable[[str], None], gone: list[str], prefix: str) -> None:
    """Put the files that ``write`` makes below a folder into ``path``, named ``prefix`` and their own name, and remove ``gone``.

    The plan stays where it is: the change of one folder is done once. ``finish`` forgets it.
    """
    files = Files(spark)
    if not files.exists(f"{folder}/plan"):
        write(f"{folder}/rows")
        files.write(f"{folder}/plan.tmp", json.dumps({"new": files.below(f"{folder}/rows"), "gone": gone}))
        files.rename(f"{folder}/plan.tmp", f"{folder}/plan")
    plan = json.loads(files.read(f"{folder}/plan"))
    for name in plan["new"]:
        at, _, last = name.rpartition("/")
        files.rename(f"{folder}/rows/{name}", f"{path}/{at}/{prefix}{last}" if at else f"{path}/{prefix}{last}")
    for name in plan["gone"]:
        files.delete(f"{path}/{name}")


def finish(spark: SparkSession, folder: str) -> None:
    Files(spark).delete(folder)
