"""Skill folders of agents as a Spark data source.

Each agent has a root folder, which is a partition of its own; the machines that run
the tasks must see it. Every entry of a root is a row with what it is:
``folder``, ``link`` to a folder, ``own`` (a link into the library, so an export of
ours), ``broken`` or ``file``. A root that is missing or can't be read has no rows.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewell.sources.files import decode_bytes, front_matter


class Root(InputPartition):
    def __init__(self, agent: dict):
        self.agent = agent


def kind_of(path: str, library: str | None) -> str:
    """What an entry is; a link counts for where it leads."""
    if not os.path.islink(path):
        return "folder" if os.path.isdir(path) else "file"
    if not os.path.exists(path):
        return "broken"
    if library and os.path.commonpath([os.path.realpath(path), library]) == library:
        return "own"
    return "link" if os.path.isdir(path) else "file"


def skill_of(folder: str) -> tuple[str, str]:
    """Name and description of a folder's skill file; the folder's name where there is none."""
    fallback = os.path.basename(folder)
    for name in ("SKILL.md", "skill.md"):
        try:
            with open(os.path.join(folder, name), "rb") as f:
                return front_matter(decode_bytes(f.read())[0], fallback)
        except OSError:
            continue
    return fallback, ""


class AgentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.agents = json.loads(options.get("agents", "[]"))
        self.library = options.get("library")

    def partitions(self):
        return [Root(a) for a in self.agents]

    def read(self, partition):
        if partition is None:  # no agents
            return
        agent, library = partition.agent, os.path.realpath(os.path.expanduser(self.library)) if self.library else None
        root = os.path.expanduser(agent.get("path") or "")
        try:
            names = sorted(os.listdir(root)) if root and not root.startswith("~") else []
        except OSError:
            return
        for name in names:
            path = os.path.join(root, name)
            kind = kind_of(path, library)
            title, about = skill_of(path) if kind in ("folder", "link") else (name, "")
            imported = bool(library) and os.path.exists(os.path.join(library, name))
            yield (agent.get("id"), agent.get("name"), name, title, about, path, kind, imported)


class AgentSource(DataSource):
    """``spark.read.format("agent_folders")``; options ``agents``, a JSON list of ``{id, name, path}``, and ``library``."""

    @classmethod
    def name(cls):
        return "agent_folders"

    def schema(self):
        return "agent_id string, agent_name string, dir_name string, name string, description string, path string, kind string, already_imported boolean"

    def reader(self, schema):
        return AgentReader(self.options)


def scan_agents(spark: SparkSession, agents: list[dict], library: str | None = None) -> DataFrame:
    """Skills that agents have: folders, which can be imported, and links to folders, which are only shown (``is_symlink``)."""
    spark.dataSource.register(AgentSource)
    reader = spark.read.format("agent_folders").option("agents", json.dumps(agents))
    found = (reader.option("library", library) if library else reader).load()
    return found.where(F.col("kind").isin("folder", "link")).select("agent_id", "agent_name", "dir_name", "name", "description", "path", (F.col("kind") == "link").alias("is_symlink"), "already_imported")
