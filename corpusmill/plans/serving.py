"""A model server that lives as long as a run: checked, started, waited for, and ended with all of its processes."""

from __future__ import annotations

import os
import shlex
import shutil
import signal
import socket
import subprocess
import tempfile
import time
from pathlib import Path
from urllib.error import URLError
from urllib.parse import urlsplit
from urllib.request import urlopen


class Server:
    """with Server("serve --port 8000", "http://127.0.0.1:8000"): ... The server is ready when url/v1/models answers; one
    that ends before, or is not ready in time, is an error that tells the end of its output."""

    def __init__(self, command: str, url: str, model_dir: str | None = None, timeout: float = 600.0, pause: float = 2.0):
        self.command, self.url, self.model_dir, self.timeout, self.pause = shlex.split(command), url.rstrip("/"), model_dir, timeout, pause

    def check(self) -> None:
        at = urlsplit(self.url)
        if not self.command or shutil.which(self.command[0]) is None:
            raise ValueError(f"no such program: {' '.join(self.command[:1])}")
        with socket.socket() as s:
            if s.connect_ex((at.hostname, at.port or 80)) == 0:
                raise ValueError(f"something answers at {self.url} already")
        if self.model_dir is None:
            return
        folder = Path(self.model_dir)
        if not (folder / "config.json").is_file() or not (any(folder.glob("*.safetensors")) or any(folder.glob("pytorch_model*.bin"))):
            raise ValueError(f"{folder} holds no weights or no config.json")

    def ready(self) -> bool:
        try:
            with urlopen(f"{self.url}/v1/models", timeout=2) as reply:
                return reply.status == 200
        except (URLError, OSError):
            return False

    def __enter__(self) -> Server:
        self.check()
        self.said = tempfile.TemporaryFile()
        self.process = subprocess.Popen(self.command, stdin=subprocess.DEVNULL, stdout=self.said, stderr=subprocess.STDOUT, start_new_session=True)
        end = time.monotonic() + self.timeout
        try:
            while not self.ready():
                if self.process.poll() is not None or time.monotonic() > end:
                    what = "the server ended" if self.process.poll() is not None else f"the server is not ready after {self.timeout:g} s"
                    self.said.seek(0)
                    raise RuntimeError(f"{what}: {self.said.read()[-2000:].decode(errors='replace')}")
                time.sleep(self.pause)
        except BaseException:
            self.__exit__()
            raise
        return self

    def __exit__(self, *_) -> None:
        for how, wait in ((signal.SIGTERM, 10), (signal.SIGKILL, None)):
            try:
                os.killpg(self.process.pid, how)
                self.process.wait(wait)
                break
            except ProcessLookupError:
                self.process.wait()
                break
            except subprocess.TimeoutExpired:
                continue
        self.said.close()
