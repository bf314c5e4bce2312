"""Services outside the cluster, behind small interfaces, with local stand-ins. Objects go to the executors with the code."""

from __future__ import annotations

from typing import Protocol

from quarrysift.functions import codeast
from quarrysift.sources.files import Folder


class SpecProvider(Protocol):
    def specify(self, codes: list[str]) -> list[str]: ...


class Verifier(Protocol):
    def verify(self, codes: list[str]) -> list[tuple[int, str]]:
        """(exit code, output) of each program."""
        ...


class RepoSource(Protocol):
    def list(self, repo: str) -> list[tuple[str, int]]:
        """(path, bytes) of each file of a repository."""
        ...

    def read(self, repo: str, path: str) -> str: ...


class StubSpecs:
    """Specifications that only tell the length of the code."""

    def specify(self, codes: list[str]) -> list[str]:
        return [f"// spec of {len(c or '')} characters" for c in codes]


class EchoSpecs:
    """The code itself as the specification, in a fenced block below the prompt; a prompt is a template with {code}."""

    def __init__(self, system: str, user: str):
        self.system, self.user = system, user

    def specify(self, codes: list[str]) -> list[str]:
        return [f"{self.system}\n{self.user.replace('{code}', '')}\n```dafny\n{c or ''}\n```" for c in codes]


class SyntaxVerifier:
    """Says that a program is verified if it is valid Python, in the words of a verifier's log."""

    def verify(self, codes: list[str]) -> list[tuple[int, str]]:
        ok = [codeast.features(c or "")["valid"] for c in codes]
        return [(0, "Dafny program verifier finished with 1 verified, 0 errors") if v else (1, "program.dfy(1,1): Error: invalid program\n1 parse errors detected in program.dfy") for v in ok]


class FolderRepos:
    """Repositories as folders below a root that all executors reach."""

    def __init__(self, root: str):
        self.root, self._folder = root, None

    def __getstate__(self) -> dict:
        return {"root": self.root, "_folder": None}

    @property
    def folder(self) -> Folder:
        self._folder = self._folder or Folder(self.root)
        return self._folder

    def list(self, repo: str) -> list[tuple[str, int]]:
        return [(p, n) for p, n in self.folder.list(repo) if p.endswith(".py")]

    def read(self, repo: str, path: str) -> str:
        return self.folder.read(f"{repo}/{path}").decode(errors="replace")
