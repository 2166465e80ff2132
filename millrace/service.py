"""Submitting pipelines and projects, and asking for their state: what a thin HTTP layer would call."""

from __future__ import annotations

import io
import json
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

import yaml
from pyspark.sql import SparkSession

from millrace.core.runtime import scratch
from millrace.plans.compiler import run_transformation
from millrace.plans.convert import convert_project
from millrace.plans.jobs import JobContext, run_job
from millrace.plans.model import load_job, load_transformation


@dataclass
class Execution:
    id: str
    kind: str
    name: str
    status: str = "PENDING"
    started_at: str | None = None
    completed_at: str | None = None
    error_message: str | None = None
    result: bool | None = None


@dataclass
class Project:
    id: str
    name: str
    files: dict[str, bytes]
    job: str
    status: str = "UPLOADED"
    error_message: str | None = None
    definitions: dict[str, str] = field(default_factory=dict)
    executions: list[str] = field(default_factory=list)


class Service:
    """Runs at most `workers` pipelines at a time; with a folder, the records of executions outlive the process."""

    def __init__(self, spark: SparkSession, workers: int = 4, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self._pool, self._lock = ThreadPoolExecutor(workers), threading.Lock()
        self._records: dict[str, Execution] = {}
        self._futures: dict[str, Future] = {}
        self._projects: dict[str, Project] = {}
        if folder:
            os.makedirs(folder, exist_ok=True)
            for n in sorted(os.listdir(folder)):
                if n.endswith(".json"):
                    with open(os.path.join(folder, n), encoding="utf-8") as f:
                        r = Execution(**json.load(f))
                    if r.status in ("PENDING", "RUNNING"):
                        r.status, r.error_message = "FAILED", "the process ended"
                    self._records[r.id] = r

    def _save(self, r: Execution) -> None:
        if self.folder:
            path = os.path.join(self.folder, f"{r.id}.json")
            with open(path + ".part", "w", encoding="utf-8") as f:
                json.dump(asdict(r), f)
            os.replace(path + ".part", path)

    def _submit(self, kind: str, name: str, work) -> str:
        r = Execution(str(uuid.uuid4()), kind, name)
        with self._lock:
            self._records[r.id] = r
            self._save(r)

        def run() -> None:
            now = lambda: datetime.now(timezone.utc).isoformat()
            r.status, r.started_at = "RUNNING", now()
            try:
                with scratch():
                    r.result = work()
                r.status = "COMPLETED" if r.result is not False else "FAILED"
            except Exception as e:
                r.status, r.error_message = "FAILED", str(e)[:2000]
            r.completed_at = now()
            with self._lock:
                self._save(r)

        self._futures[r.id] = self._pool.submit(run)
        return r.id

    def submit_transformation(self, definition: str | dict, variables: dict[str, str] | None = None) -> str:
        d = load_transformation(definition)
        return self._submit("TRANSFORMATION", d.name, lambda: run_transformation(self.spark, d, variables) is not None)

    def submit_job(self, definition: str | dict, values: dict[str, str] | None = None) -> str:
        d = load_job(definition)
        return self._submit("JOB", d.name, lambda: run_job(self.spark, d, JobContext(self.spark, dict(values or {}))))

    # projects: uploaded XML definitions, converted and run as a whole

    def create_project(self, name: str, job: tuple[str, bytes], transformations: dict[str, bytes]) -> str:
        """Keep a job (file name, content) and its transformations; nothing is read before `convert_project`."""
        p = Project(str(uuid.uuid4()), name, {job[0]: job[1], **transformations}, job[0])
        with self._lock:
            self._projects[p.id] = p
        return p.id

    def projects(self) -> list[Project]:
        return list(self._projects.values())

    def project(self, id_: str) -> Project:
        return self._projects[id_]

    def convert_project(self, id_: str) -> Project:
        """Convert all files of a project; its definitions are then at hand by name. A file that can't be converted leaves
        the project FAILED, with the reason."""
        p = self._projects[id_]
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for n, data in p.files.items():
                z.writestr(n, data)
        try:
            with zipfile.ZipFile(io.BytesIO(convert_project(packed.getvalue()))) as z:
                p.definitions = {n: z.read(n).decode("utf-8") for n in z.namelist()}
            p.status, p.error_message = "CONVERTED", None
        except Exception as e:
            p.status, p.error_message = "FAILED", str(e)[:2000]
        return p

    def execute_project(self, id_: str, values: dict[str, str] | None = None) -> str:
        """Run the job of a converted project in the background, with its definitions as files of one folder."""
        p = self._projects[id_]
        if p.status != "CONVERTED":
            raise ValueError(f"project {p.name} isn't converted")
        folder = tempfile.mkdtemp(prefix="millrace-project-")  # read by the driver only
        for n, text in p.definitions.items():
            with open(os.path.join(folder, n), "w", encoding="utf-8") as f:
                f.write(text)
        stem = os.path.splitext(os.path.basename(p.job))[0]
        job = next((n for n in (f"{stem}.yaml", f"{stem}_job.yaml") if "entries" in (yaml.safe_load(p.definitions.get(n, "")) or {})), None)
        if job is None:
            raise ValueError(f"project {p.name} has no job")
        d = load_job(p.definitions[job])

        def work() -> bool:
            try:
                return run_job(self.spark, d, JobContext(self.spark, {**(values or {}), "basePath": folder}))
            finally:
                shutil.rmtree(folder, ignore_errors=True)

        e = self._submit("JOB", d.name, work)
        p.executions.append(e)
        return e

    def executions(self, project: str) -> list[Execution]:
        return [self._records[e] for e in self._projects[project].executions]

    def get(self, id_: str) -> Execution | None:
        return self._records.get(id_)

    def list(self) -> list[Execution]:
        return list(self._records.values())

    def wait(self, id_: str, timeout: float | None = None) -> Execution:
        self._futures[id_].result(timeout)
        return self._records[id_]
