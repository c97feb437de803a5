"""Small files in any file system that Spark can reach, through Spark's own file system classes."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import SchemaLockTimeoutError

STALE_SECONDS = 3600.0  # a lock without a sign of life for so long has no holder


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def read(self, path: str) -> str | None:
        p, fs = self._path(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def _local(self, path: str):
        """The ``java.io.File`` of a path in a local file system, None for any other.

        There Hadoop's classes look for a file and then create it, and delete a
        file and then rename another to its name; the system does each in one step.
        """
        p, fs = self._path(path)
        kinds = ("org.apache.hadoop.fs.LocalFileSystem", "org.apache.hadoop.fs.RawLocalFileSystem")
        return fs.pathToFile(p) if any(self._jvm.java.lang.Class.forName(k).isInstance(fs) for k in kinds) else None

    def create(self, path: str, text: str) -> bool:
        """Create a file that must not exist; False if it does.  Of several that try, one succeeds."""
        p, fs = self._path(path)
        if local := self._local(path):
            local.getParentFile().mkdirs()
            if not local.createNewFile():
                return False
            stream = self._jvm.java.io.FileOutputStream(local)
        else:
            try:
                stream = fs.create(p, False)
            except Py4JJavaError as e:
                if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                    return False
                raise
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        return True

    def replace(self, path: str, text: str) -> None:
        """Put a whole file in place of another by a rename, so that readers see the old or the new one."""
        temporary = f"{path}.{uuid.uuid4().hex}"
        self.create(temporary, text)
        if local := self._local(path):
            self._jvm.java.io.File(local.getParentFile(), f".{local.getName()}.crc").delete()  # a checksum of the old file
            if not self._local(temporary).renameTo(local):
                raise OSError(f"{temporary} cannot be renamed to {path}")
            return
        p, _ = self._path(path)
        t, _ = self._path(temporary)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf) if p.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = self._jvm.java.lang.Enum.valueOf(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "OVERWRITE")
        context.rename(t, p, options)

    def move(self, path: str, to: str) -> None:
        """Rename a folder to a path that must not exist."""
        p, fs = self._path(path)
        if not fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"{path} cannot be renamed to {to}")

    def delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    @contextmanager
    def lock(self, path: str, timeout: float, stale: float = STALE_SECONDS) -> Iterator[None]:
        """Hold a lock file, which states its holder and the time of its last sign of life.

        A holder renews it while it works, so only one that is gone for ``stale``
        seconds is taken over; and it removes no lock but its own.
        """
        token, end = uuid.uuid4().hex, time.monotonic() + timeout
        while not self.create(path, f"{token} {time.time()}"):
            self._take_over(path, stale)
            if time.monotonic() > end:
                raise SchemaLockTimeoutError(f"no lock on {path} within {timeout} s")
            time.sleep(0.05)
        done = threading.Event()
        beat = threading.Thread(target=self._renew, args=(path, token, done, stale / 4), daemon=True)
        beat.start()
        try:
            yield
        finally:
            done.set()
            beat.join()
            if self._held(path)[0] == token:
                self.delete(path)

    def _held(self, path: str) -> tuple[str, float]:
        """Token and last sign of life of a lock's holder."""
        try:
            token, _, at = (self.read(path) or "").partition(" ")
            return token, float(at)
        except (ValueError, Py4JJavaError):  # it is being written, or has just gone
            return "", time.time()

    def _renew(self, path: str, token: str, done: threading.Event, every: float) -> None:
        while not done.wait(every):
            if self._held(path)[0] == token:
                self.replace(path, f"{token} {time.time()}")

    def _take_over(self, path: str, stale: float) -> None:
        """Put a lock aside whose holder is gone; of several that try, one can rename it, and a live lock is put back."""
        token, at = self._held(path)
        if time.time() - at <= stale:
            return
        aside = f"{path}.{uuid.uuid4().hex}"
        try:
            self.move(path, aside)
        except (OSError, Py4JJavaError):
            return
        now, _ = self._held(aside)
        if now != token and not self.exists(path):
            self.move(aside, path)
        else:
            self.delete(aside)
