"""What clients pass, held to the ranges that they are promised, and paths that they may not name."""

from __future__ import annotations

# Fixed ranges: how deep a traversal goes, how many rows a ranking and a list return, hops of a trace.
DEPTH = (1, 10)
TOP_K = (1, 200)
LIMIT = (1, 100)
MAX_HOPS = (1, 15)


def held(value: int, within: tuple[int, int]) -> int:
    """The whole number nearest to value within a range; anything else is an error."""
    if isinstance(value, bool) or int(value) != value:
        raise ValueError(f"{value!r} is not a whole number")
    return max(within[0], min(within[1], int(value)))


def depth_of(value: int) -> int:
    return held(value, DEPTH)


def top_k_of(value: int) -> int:
    return held(value, TOP_K)


def limit_of(value: int) -> int:
    return held(value, LIMIT)


def hops_of(value: int) -> int:
    return held(value, MAX_HOPS)


# Folders of the system and of secrets, and files that hold secrets.
_SYSTEM = ("/etc", "/root", "/proc", "/sys", "/dev", "/boot", "/var/run", "/usr", "/bin", "/sbin", "c:/windows", "c:/program files")
_SECRET_FOLDERS = {".ssh", ".aws", ".gnupg", ".kube", ".docker", ".azure"}
_SECRET_FILES = {".env", ".netrc", ".npmrc", ".pypirc", "id_rsa", "id_ed25519", "credentials", ".git-credentials"}


def is_sensitive(path: str) -> bool:
    """Whether a path that a client passes leads into the system's folders or to secrets; .. is resolved first."""
    parts: list[str] = []
    given = path.replace("\\", "/").lower()
    for part in given.split("/"):
        if part == ".." and parts:
            parts.pop()
        elif part not in ("", ".", ".."):
            parts.append(part)
    whole = ("/" if given.startswith("/") else "") + "/".join(parts)
    system = any(whole == folder or whole.startswith(f"{folder}/") for folder in _SYSTEM)
    return system or bool(_SECRET_FOLDERS & set(parts)) or bool(parts) and parts[-1] in _SECRET_FILES
