"""Jobs: entries joined by conditional hops, run in parallel.

An entry waits for all entries before it. It runs if every hop from an entry that ran is satisfied, and is skipped if
one isn't, or if all entries before it were skipped. The job's result is that of all last entries that ran. An entry
that raises fails the job.
"""

from __future__ import annotations

import logging
import os
import re
import smtplib
import threading
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass, field
from email.message import EmailMessage

from pyspark.sql import SparkSession

from millrace.operators.effects import allowed, shell
from millrace.plans.compiler import run_transformation, topological
from millrace.plans.model import JobDefinition, load_job, load_transformation
from millrace.registry import ENTRIES, Params, entry

log = logging.getLogger("millrace.jobs")


@dataclass
class JobContext:
    spark: SparkSession
    values: dict[str, str] = field(default_factory=dict)
    allow_exec: bool = False
    lock: threading.Lock = field(default_factory=threading.Lock)
    results: dict = field(default_factory=dict)
    mail: type = smtplib.SMTP


@entry("Start", "Success", "Dummy")
def _true(p: Params, c: JobContext) -> bool:
    return True


@entry("Abort")
def _abort(p: Params, c: JobContext) -> bool:
    log.error("aborted: %s", p.text("message", ""))
    return False


@entry("RunTransformation")
def _run(p: Params, c: JobContext) -> bool:
    """The file of that name in basePath (or the path itself without one). Its own parameters win over the job's values,
    empty ones too."""
    path = p.required("transformationPath")
    with c.lock:
        values = dict(c.values)
    if base := values.get("basePath"):
        path = os.path.join(base, re.split(r"[/\\]", path)[-1])
    definition = load_transformation(path)
    for k, v in definition.parameters.items():
        if not v and values.get(k):
            log.warning("%s: its empty default of %s hides the job's value", definition.name, k)
    done = run_transformation(c.spark, definition, {k: v for k, v in values.items() if k not in definition.parameters}, allow_exec=c.allow_exec, results=dict(c.results))
    with c.lock:
        c.results.update({k: v for k, v in done.results.items() if k == "rows"})
    return True


@entry("RunJob")
def _job(p: Params, c: JobContext) -> bool:
    path = p.required("jobPath")
    if base := c.values.get("basePath"):
        path = os.path.join(base, re.split(r"[/\\]", path)[-1])
    return run_job(c.spark, load_job(path), c)


@entry("SetVariable")
def _set(p: Params, c: JobContext) -> bool:
    with c.lock:
        c.values[p.required("variableName")] = p.text("variableValue", "")
    return True


@entry("GetVariable")
def _get(p: Params, c: JobContext) -> bool:
    name = p.required("variableName")
    with c.lock:
        c.values[p.text("contextKey", name)] = os.environ.get(name, "")
    return True


@entry("WriteToLog")
def _log(p: Params, c: JobContext) -> bool:
    log.info("%s", p.text("message", ""))
    return True


@entry("FileExists")
def _exists(p: Params, c: JobContext) -> bool:
    return os.path.exists(p.required("filePath"))


@entry("ExecProcess")
def _exec(p: Params, c: JobContext) -> bool:
    allowed(c)
    command = p.text("command")
    return command is not None and shell(command)[1] == "0"


@entry("ExecSQL")
def _sql(p: Params, c: JobContext) -> bool:
    """One statement, committed."""
    from millrace.registry import Context
    from millrace.sources.jdbc import _Connection

    with _Connection(p, Context(c.spark)) as db:
        db.run(p.required("sql"))
    return True


@entry("Mail")
def _mail(p: Params, c: JobContext) -> bool:
    secure, tls = p.flag("useSSL", False), p.flag("useSTARTTLS", False)
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = p.required("from"), p.required("to"), p.text("subject", "")
    m.set_content(p.text("body", ""))
    kind = smtplib.SMTP_SSL if secure and c.mail is smtplib.SMTP else c.mail
    with kind(p.required("host"), p.integer("port", 465 if secure else 587 if tls else 25), timeout=30) as s:
        if tls:
            s.starttls()
        if p.text("user"):
            s.login(p["user"], p.text("password", ""))
        s.send_message(m)
    return True


def _satisfied(evaluation: str | None, result: bool) -> bool:
    return {"success": result, "failure": not result}.get((evaluation or "").lower(), True)


def run_job(spark: SparkSession, definition: JobDefinition | str | dict, context: JobContext | dict | None = None) -> bool:
    if not isinstance(definition, JobDefinition):
        definition = load_job(definition)
    c = context if isinstance(context, JobContext) else JobContext(spark, dict(context or {}))
    for k, v in definition.parameters.items():
        c.values.setdefault(k, v)
    entries = {e.id: e for e in definition.entries}
    hops = [h for h in definition.hops if h.enabled and h.from_ in entries and h.to in entries]
    for e in entries.values():
        if e.type not in ENTRIES:
            raise ValueError(f"unknown job entry type {e.type}")
    result: dict[str, bool | None] = {}
    with ThreadPoolExecutor(max(len(entries), 1)) as pool:
        futures = {}

        def run(i: str) -> bool | None:
            before = [h for h in hops if h.to == i]
            got = [(h, futures[h.from_].result()) for h in before]  # raises what an entry before raised
            ran = [(h, r) for h, r in got if r is not None]
            if before and (not ran or not all(_satisfied(h.evaluation, r) for h, r in ran)):
                return None
            return bool(ENTRIES[entries[i].type](Params(entries[i].params), c))

        for i in topological(list(entries), [(h.from_, h.to) for h in hops]):
            futures[i] = pool.submit(copy_context().run, run, i)
        result = {i: f.result() for i, f in futures.items()}
    last = [i for i in entries if not any(h.from_ == i for h in hops)]
    return all(result[i] for i in last if result[i] is not None)
