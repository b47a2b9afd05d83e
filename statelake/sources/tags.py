"""Named moments, versioned snapshots and run records: small files beside a table."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from statelake.sources.paths import Folder


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


class Tags:
    """Named UTC moments."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def get(self, name: str) -> datetime | None:
        return datetime.fromisoformat(self.folder.read(name + ".tag")) if self.folder.exists(name + ".tag") else None

    def touch(self, name: str, at: datetime | None = None) -> datetime:
        at = at or utc_now()
        if at.tzinfo is None:
            raise ValueError("a tag needs a time zone")
        self.folder.write(name + ".tag", at.isoformat())
        return at

    def delete(self, name: str) -> None:
        self.folder.delete(name + ".tag")

    def is_latest(self, name: str, dependencies: list[str]) -> bool:
        """Whether ``name`` is strictly newer than all dependencies that exist; never if it or all of them are absent."""
        own = self.get(name)
        others = [t for d in dependencies if (t := self.get(d)) is not None]
        return own is not None and bool(others) and all(own > t for t in others)


class Versions:
    """Snapshots of small files: ``versions/YYYY/MM/<time>/<name>``. Unchanged content is not stored again."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def make(self, name: str, text: str, at: datetime | None = None) -> str | None:
        digest = hashlib.sha256(text.encode()).hexdigest()
        mark = f"versions/.seen/{name}/{digest}"
        self.folder.write(name, text)
        if self.folder.exists(mark):
            return None
        at = at or utc_now()
        path = f"versions/{at:%Y/%m}/{at:%Y%m%dT%H%M%S%fZ}/{name}"
        self.folder.write(path, text)
        self.folder.write(mark, path)
        return path

    def list(self, name: str) -> list[str]:
        return sorted("versions/" + p for p, _ in self.folder.walk("versions") if p.endswith("/" + name) and ".seen" not in p and not p.rsplit("/", 1)[-1].endswith(".crc"))


@dataclass
class Job:
    """A run: what it did, when, and how it ended."""

    name: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "pending"
    started: str | None = None
    stopped: str | None = None
    exc: str | None = None
    counters: dict[str, int] = field(default_factory=dict)

    def count(self, what: str, n: int = 1) -> None:
        self.counters[what] = self.counters.get(what, 0) + n


class Jobs:
    def __init__(self, folder: Folder):
        self.folder = folder

    def _save(self, job: Job) -> None:
        self.folder.write(f"{job.name}/{job.started}-{job.id}.json", json.dumps(asdict(job)))

    def run(self, name: str, work: Callable[[Job], object]) -> tuple[Job, object]:
        """Run ``work``; its record is saved at start and end. An error is recorded and raised again."""
        job = Job(name, status="running", started=f"{utc_now():%Y%m%dT%H%M%S%fZ}")
        self._save(job)
        try:
            result = work(job)
            job.status = "done"
            return job, result
        except Exception as error:
            job.status, job.exc = "failed", f"{type(error).__name__}: {error}"
            raise
        finally:
            job.stopped = utc_now().isoformat()
            self._save(job)

    def iterate(self, name: str) -> list[Job]:
        return [Job(**json.loads(self.folder.read(f"{name}/{n}"))) for n in self.folder.names(name)]

    def latest(self, name: str) -> Job | None:
        return (self.iterate(name) or [None])[-1]
