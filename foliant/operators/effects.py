"""Writing to files: never over what is there, always read again; small jobs of one machine and their order."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import shutil
import threading
import time
import uuid
import zipfile
from collections import deque
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

# Waits between tries of a copy, kinds of report files, and what an undo log's rows hold.
WAITS = (1, 2, 4, 8, 16)
REPORTS, REPORT_BYTES = (".txt", ".md", ".json", ".csv", ".log"), 1 << 20
UNDO = ("action", "source", "destination", "size", "sha256", "timestamp")


class Refused(Exception):
    """Something is there already, or differs from what it should be."""


def digest(path: str) -> str:
    whole = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            whole.update(block)
    return whole.hexdigest()


def _placed(dest: str, write: Callable[[io.BufferedWriter], None], check: Callable[[str], None] = lambda part: None) -> None:
    """Write beside ``dest``, check the part, then link it there: fails if something has come there meanwhile."""
    os.makedirs(os.path.dirname(os.path.abspath(dest)), exist_ok=True)
    part = f"{dest}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "xb") as file:
            write(file)
            file.flush()
            os.fsync(file.fileno())
        check(part)
        os.link(part, dest)
    except FileExistsError as there:
        raise Refused(f"exists: {dest}") from there
    finally:
        if os.path.exists(part):
            os.unlink(part)


def write_json(path: str, payload) -> str:
    """written, or unchanged if the file has the same text; another text is refused."""
    text = json.dumps(payload, indent=2, ensure_ascii=False, sort_keys=True) + "\n"
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            if file.read() == text:
                return "unchanged"
        raise Refused(f"another text is there: {path}")
    _placed(path, lambda file: file.write(text.encode()))
    return "written"


def save_register(path: str, document: dict, errors: Callable[[dict], list[str]]) -> None:
    """Replace a register in one step and keep the one before as ``.prev``; a document with errors is not written."""
    if found := errors(document):
        raise Refused("; ".join(found))
    fresh = f"{path}.{uuid.uuid4().hex}.part"
    with open(fresh, "x", encoding="utf-8") as file:
        json.dump(document, file, indent=2, ensure_ascii=False)
        file.flush()
        os.fsync(file.fileno())
    if os.path.exists(path):
        keep = f"{path}.{uuid.uuid4().hex}.part"
        shutil.copyfile(path, keep)
        os.replace(keep, f"{path}.prev")
    os.replace(fresh, path)


def apply_entries(path: str, register: dict, act: Callable[[dict], dict], errors: Callable[[dict], list[str]]) -> dict:
    """Act on each entry that is not done and save the register after each, so a stop loses one entry at most."""
    for n, entry in enumerate(register["entries"]):
        if entry.get("status") != "done":
            register["entries"][n] = entry | act(entry)
            save_register(path, register, errors)
    return register


def final_line(ok: int, skipped: int, failed: int) -> str:
    return f"FINAL ok={ok} skipped={skipped} failed={failed}"


def log_event(level: str, action: str, path: str, **more) -> str:
    return json.dumps({"level": level, "action": action, "path": path, **more}, ensure_ascii=False, sort_keys=True)


def copy_verified(src: str, dest: str, *, undo: list[dict] | None = None, sleep: Callable[[float], None] = time.sleep, copy: Callable[[str, io.BufferedWriter], None] | None = None) -> None:
    """Copy, waiting longer after each try that finds the file locked; the copy is read again, and an undo row is added."""

    def plain(path: str, file: io.BufferedWriter) -> None:
        with open(path, "rb") as source:
            shutil.copyfileobj(source, file)

    want = digest(src)

    def check(part: str) -> None:
        if digest(part) != want:
            raise Refused("the copy differs")

    for wait in (*WAITS, None):
        try:
            _placed(dest, lambda file: (copy or plain)(src, file), check)
            break
        except PermissionError:
            if wait is None:
                raise
            sleep(wait)
    if undo is not None:
        undo.append(undo_row("COPY", src, dest, os.path.getsize(dest), want))


def write_stream(dest: str, chunks: Iterable[bytes], expected: int | None = None) -> int:
    """Write a download; a wrong number of bytes is refused and leaves nothing."""
    size = 0

    def write(file: io.BufferedWriter) -> None:
        nonlocal size
        for chunk in chunks:
            file.write(chunk)
            size += len(chunk)

    def check(part: str) -> None:
        if expected is not None and size != expected:
            raise Refused(f"{size} bytes instead of {expected}")

    _placed(dest, write, check)
    return size


def zip_original(src: str, dest: str) -> str:
    """A stored archive of one file, opened again: one member of its name whose digest is the file's, which is returned."""
    want = digest(src)

    def write(file: io.BufferedWriter) -> None:
        with zipfile.ZipFile(file, "w", zipfile.ZIP_STORED) as z:
            z.write(src, os.path.basename(src))

    _placed(dest, write, lambda part: verify_zip(part, os.path.basename(src), want))
    return want


def verify_zip(path: str, name: str, sha256: str) -> None:
    with zipfile.ZipFile(path) as z:
        if z.namelist() != [name] or z.testzip() is not None or hashlib.sha256(z.read(name)).hexdigest() != sha256:
            raise Refused(f"not the archive of {name}: {path}")


def reassemble(parts: list[str], dest: str) -> int:
    """One file of two or more numbered parts, in the order given."""
    if len(parts) < 2:
        raise Refused("fewer than two parts")

    def write(file: io.BufferedWriter) -> None:
        for part in parts:
            with open(part, "rb") as source:
                shutil.copyfileobj(source, file)

    _placed(dest, write)
    return os.path.getsize(dest)


def undo_row(action: str, src: str, dest: str | None, size: int | None, sha256: str | None) -> dict:
    return dict(zip(UNDO, (action.upper(), src, dest or "", "" if size is None else size, (sha256 or "").upper(), datetime.now().astimezone().isoformat(timespec="seconds"))))


def append_undo(path: str, rows: list[dict]) -> None:
    fresh = not os.path.exists(path)
    with open(path, "a", newline="", encoding="utf-8-sig" if fresh else "utf-8") as file:
        out = csv.DictWriter(file, UNDO)
        if fresh:
            out.writeheader()
        out.writerows(rows)


def execute(op: str, src: str | None, dst: str | None, sha256: str | None, recycle: Callable[[str], None]) -> tuple[str, str]:
    """(status, note) of one action, checked again right before it is done; a move to another volume is a verified copy."""
    try:
        if op == "mkdir":
            if os.path.isdir(dst):
                return "ok", "already there"
            os.makedirs(dst)
            return "ok", ""
        if not os.path.exists(src):
            return "failed", "source is missing"
        if sha256 and os.path.isfile(src) and digest(src) != sha256.lower():
            return "failed", "sha256 differs"
        if op == "recycle":
            recycle(src)
            return "ok", ""
        if os.path.exists(dst):
            return "failed", "destination exists"
        if op == "copy":
            copy_verified(src, dst)
        elif os.stat(src).st_dev == os.stat(os.path.dirname(dst)).st_dev:
            os.rename(src, dst)
        else:
            copy_verified(src, dst)
            recycle(src)
        return "ok", ""
    except (OSError, Refused) as problem:
        return "failed", str(problem)


def run_actions(actions: list[dict], recycle: Callable[[str], None], *, stop_on_error: bool = False) -> list[dict]:
    """Results of a plan's actions in order; after a failure the rest is skipped if so asked."""
    out: list[dict] = []
    stopped = False
    for n, a in enumerate(actions):
        status, note = ("skipped", "stopped after an error") if stopped else execute(a["op"], a.get("src"), a.get("dst"), a.get("sha256"), recycle)
        stopped = stopped or (stop_on_error and status == "failed")
        out.append({"index": n, "op": a["op"], "status": status, "reason": note})
    return out


def backup(dest: str, folder: str | None = None) -> str:
    """Move what lies at ``dest`` to a free ``name.digest[.n].bak``."""
    stem = os.path.join(folder or os.path.dirname(dest), f"{os.path.basename(dest)}.{digest(dest)}")
    for name in (f"{stem}.bak", *(f"{stem}.{n}.bak" for n in range(2, 1000))):
        if not os.path.exists(name):
            os.rename(dest, name)
            return name
    raise Refused("no free backup name")


def copy_reports(job: str, target: str) -> list[str]:
    """Copy a job's small text files; names of those taken."""
    names = [n for n in sorted(os.listdir(job)) if n.lower().endswith(REPORTS) and os.path.isfile(os.path.join(job, n)) and os.path.getsize(os.path.join(job, n)) <= REPORT_BYTES]
    for n in names:
        copy_verified(os.path.join(job, n), os.path.join(target, n))
    return names


def run_bounded(function: Callable, items: list, *, workers: int = 1, spacing: float = 1.0, clock=time.monotonic, sleep=time.sleep) -> list:
    """Results in the order of the items; at most two run at once, and starts are ``spacing`` seconds apart."""
    gate, last = threading.Lock(), [None]

    def one(item):
        with gate:
            if last[0] is not None and (rest := last[0] + spacing - clock()) > 0:
                sleep(rest)
            last[0] = clock()
        return function(item)

    with ThreadPoolExecutor(max(1, min(2, workers))) as pool:
        return list(pool.map(one, items))


class Jobs:
    """Background jobs, one at a time; each keeps its last lines."""

    def __init__(self, lines: int = 250):
        self.lines, self.lock, self.current = lines, threading.Lock(), None

    def start(self, name: str, work: Callable[[Callable[[str], None]], object]) -> dict:
        with self.lock:
            if self.current and self.current["state"] == "running":
                raise Refused(f"{self.current['name']} is running")
            job = {"name": name, "state": "running", "log": deque(maxlen=self.lines), "result": None, "error": None}
            self.current = job

        def run() -> None:
            try:
                job["result"] = work(job["log"].append)
                job["state"] = "done"
            except Exception as problem:  # the job's state tells
                job["state"], job["error"] = "failed", str(problem)

        job["thread"] = threading.Thread(target=run, daemon=True)
        job["thread"].start()
        return job
