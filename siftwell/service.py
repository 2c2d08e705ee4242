"""The three tools over allowed repositories: typed requests, schemas, and one public error.

A failure of any kind reaches the caller as ``ServiceError`` with a message that tells nothing of the file system; what
happened is the error's cause. A path outside the allowed roots, one that doesn't exist and one that isn't a folder can't
be told from each other.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import asdict, dataclass

from siftwell.engine import Engine, Incompatible
from siftwell.operators import maintenance as M
from siftwell.plans.modes import MODES
from siftwell.sources.repository import Cancelled

UNAVAILABLE = "The repository isn't available."
BACKENDS = ("auto", "python")


class ServiceError(RuntimeError):
    """What a caller may know of a failure."""


@dataclass(frozen=True)
class Repository:
    root: str
    place: str


class Repositories:
    """Folders at or below the allowed roots, whatever links lead to."""

    def __init__(self, allowed: list[str]):
        self.allowed = [os.path.realpath(os.path.expanduser(a)) for a in allowed]

    def holds(self, path: str) -> bool:
        return any(path == a or path.startswith(a.rstrip("/") + "/") for a in self.allowed)

    def resolve(self, path: str, engine: Engine) -> Repository:
        if not path or len(path) > 4096 or "\0" in path:
            raise ServiceError(UNAVAILABLE)
        plain = os.path.abspath(os.path.expanduser(path))
        # outside of the roots nothing is looked up but where links lead
        real = os.path.realpath(plain) if self.holds(plain) or self.holds(os.path.realpath(plain)) else ""
        if not real or not self.holds(real) or not os.path.isdir(real):
            raise ServiceError(UNAVAILABLE)
        return Repository(real, engine.place(real))


@dataclass(frozen=True)
class SearchRequest:
    repository_path: str
    query: str
    mode: str = "auto"
    top_k: int = 5
    path: str | None = None
    backend: str = "auto"
    max_snippet_chars: int = 12_000

    def __post_init__(self) -> None:
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
        if not (
            isinstance(self.query, str) and 1 <= len(self.query) <= 2000 and self.query.strip() and self.mode in MODES and whole(self.top_k) and 1 <= self.top_k <= 20
            and (self.path is None or isinstance(self.path, str) and len(self.path) <= 4096) and self.backend in BACKENDS and whole(self.max_snippet_chars) and 1 <= self.max_snippet_chars <= 32_000
        ):
            raise ServiceError("The request isn't valid.")
        if self.mode == "fuzzy" and len(self.query) > 256:
            raise ServiceError("A fuzzy query has at most 256 characters.")


_path = {"type": "string", "minLength": 1, "maxLength": 4096}
TOOLS = {
    "index_repository": {"readOnly": False, "properties": {"repository_path": _path}, "required": ["repository_path"]},
    "get_index_status": {"readOnly": True, "properties": {"repository_path": _path}, "required": ["repository_path"]},
    "search_code": {
        "readOnly": True,
        "properties": {
            "repository_path": _path, "query": {"type": "string", "minLength": 1, "maxLength": 2000}, "mode": {"enum": list(MODES), "default": "auto"}, "top_k": {"type": "integer", "minimum": 1, "maximum": 20, "default": 5},
            "path": {"type": ["string", "null"], "maxLength": 4096, "default": None}, "backend": {"enum": list(BACKENDS), "default": "auto"}, "max_snippet_chars": {"type": "integer", "minimum": 1, "maximum": 32_000, "default": 12_000},
        },
        "required": ["repository_path", "query"],
    },
}


class Service:
    def __init__(self, engine: Engine, allowed: list[str]):
        self.engine, self.repositories = engine, Repositories(allowed)

    def _safely(self, what: Callable[[], dict]) -> dict:
        try:
            return what()
        except (ServiceError, Cancelled):
            raise
        except M.Busy as error:
            raise ServiceError("The repository is being indexed.") from error
        except Incompatible as error:
            raise ServiceError("The index was made with another model; index the repository again.") from error
        except FileNotFoundError as error:
            raise ServiceError("The repository isn't indexed.") from error
        except Exception as error:
            raise ServiceError("The request failed.") from error

    def index_repository(self, repository_path: str) -> dict:
        """Create or update a repository's index."""
        at = self.repositories.resolve(repository_path, self.engine)
        return self._safely(lambda: self.engine.index(at.root))

    def get_index_status(self, repository_path: str) -> dict:
        """Whether an index is missing, being made, stale or ready."""
        at = self.repositories.resolve(repository_path, self.engine)
        return self._safely(lambda: self.engine.status(at.root))

    def search_code(self, repository_path: str, query: str, **options) -> dict:
        """Complete symbols or files that answer a query."""
        try:
            request = SearchRequest(repository_path, query, **options)
        except TypeError as error:
            raise ServiceError("The request isn't valid.") from error
        at = self.repositories.resolve(repository_path, self.engine)
        return self._safely(lambda: asdict(self.engine.search(at.root, request.query, request.top_k, request.mode, request.path, request.max_snippet_chars)))

    def list_available_indexes(self) -> list[dict]:
        """The newest index of every allowed repository."""
        found = self._safely(lambda: {"all": M.available(self.engine.spark, self.engine.data_dir)})["all"]
        return [n for n in found if self.repositories.holds(n.get("root", "")) and n["place"].split("/")[-1] == os.path.basename(self.engine.place(n["root"]))]

    def call(self, tool: str, arguments: dict) -> dict:
        """A tool by name; arguments that its schema doesn't have are an error."""
        schema = TOOLS.get(tool)
        if schema is None or not set(schema["required"]) <= set(arguments) <= set(schema["properties"]):
            raise ServiceError("The request isn't valid.")
        return getattr(self, tool)(**arguments)
