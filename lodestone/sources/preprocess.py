"""C and C++ through the compiler's preprocessor, many files a process. Off unless asked for, as it takes the directives
that macros and includes are found by."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from dataclasses import dataclass

from lodestone.sources.linemap import GCC, MSVC


@dataclass(frozen=True)
class PreprocessConfig:
    enabled: bool = False
    include_paths: tuple[str, ...] = ()
    defines: tuple[str, ...] = ()
    extra_flags: tuple[str, ...] = ()
    batch_size: int = 50
    compiler: str = ""  # found on the path if empty
    timeout_s: int = 120


def detect_compiler(windows: bool = os.name == "nt") -> str:
    return next((c for c in (("cl", "clang", "gcc") if windows else ("gcc", "clang")) if shutil.which(c)), "")


def normalized(path: str) -> str:
    return path.replace("\\", "/")


def command(compiler: str, bundle: str, lang: str, config: PreprocessConfig) -> list[str]:
    """The call as a list of arguments; no shell reads it."""
    if os.path.basename(compiler).removesuffix(".exe") == "cl":
        return [compiler, "/nologo", "/E", "/TP" if lang == "cpp" else "/TC", *(f"/I{p}" for p in config.include_paths), *(f"/D{d}" for d in config.defines), *config.extra_flags, bundle]
    return [compiler, "-E", "-x", "c++" if lang == "cpp" else "c", *(f"-I{p}" for p in config.include_paths), *(f"-D{d}" for d in config.defines), *config.extra_flags, bundle]


def parse_marker(line: str) -> tuple[int, str] | None:
    """(line, file) of a marker of either kind."""
    m = re.match(GCC, line) or re.match(MSVC, line)
    return (int(m[1]), normalized(m[2].replace("\\\\", "\\"))) if m else None


def split_output(output: str, wanted: set[str]) -> dict[str, tuple[str, list[int]]]:
    """By file: its lines of a preprocessor's output, and the line that each came from."""
    found: dict[str, tuple[list[str], list[int]]] = {}
    now, number = None, 0
    for line in output.split("\n"):
        marker = parse_marker(line)
        if marker:
            number, name = marker
            now = found.setdefault(name, ([], [])) if name in wanted else None
            continue
        if now is not None:
            now[0].append(line)
            now[1].append(number)
        number += 1
    return {name: ("\n".join(lines) + "\n", numbers) for name, (lines, numbers) in found.items()}


def preprocess_batch(languages: dict[str, str], config: PreprocessConfig) -> dict[str, tuple[str, list[int]]]:
    """Text and line numbers of the files (path: language) that came through; the others are for the caller to read raw.

    C and C++ go apart. Each process gets a file of includes in the task's temporary folder, which nothing else reads.
    """
    compiler = config.compiler or detect_compiler()
    out: dict[str, tuple[str, list[int]]] = {}
    if not compiler:
        return out
    for lang in ("c", "cpp"):
        paths = [p for p, x in languages.items() if x == lang and os.path.isabs(p) and os.path.exists(p)]
        for at in range(0, len(paths), max(1, config.batch_size)):
            part = {normalized(p): p for p in paths[at : at + max(1, config.batch_size)]}
            with tempfile.TemporaryDirectory() as folder:
                bundle = os.path.join(folder, "bundle.cpp" if lang == "cpp" else "bundle.c")
                with open(bundle, "w", encoding="utf-8") as f:
                    f.writelines(f'#include "{p}"\n' for p in part)
                try:
                    done = subprocess.run(command(compiler, bundle, lang, config), capture_output=True, timeout=config.timeout_s, check=False)
                except (OSError, subprocess.TimeoutExpired):
                    continue
            for name, made in split_output(done.stdout.decode("utf-8", "replace"), set(part)).items():
                if made[0].strip():
                    out[part[name]] = made
    return out
