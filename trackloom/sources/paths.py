"""Names of a recording's files, by suffix."""

from __future__ import annotations

# Suffixes of a recording's tables and sidecars.
SUFFIXES = {
    "detections": "_detections.csv", "trajectory": "_trajectory.csv", "audited": "_audited.csv", "swaps": "_swaps.csv",
    "candidates": "_candidates.csv", "verdicts": "_verdicts.csv", "summary": "_summary.csv", "fingerprints": "_fingerprints.parquet",
    "arena": "_arena.json", "rois": "_rois.json", "params": "_params.json",
}


def path_of(video: str, kind: str) -> str:
    """The file of this kind beside a video."""
    folder, _, name = video.rpartition("/")
    stem = name.rpartition(".")[0] or name
    return f"{folder}/{stem}{SUFFIXES[kind]}" if folder else f"{stem}{SUFFIXES[kind]}"


def stem_of(path: str) -> str:
    """The recording's name in any of its files' paths."""
    name = path.rpartition("/")[2]
    for suffix in sorted(SUFFIXES.values(), key=len, reverse=True):
        if name.endswith(suffix):
            return name[: -len(suffix)]
    return name.rpartition(".")[0] or name


def swap_log_path(audited: str) -> str:
    """Beside the audited table; refused if both would be one file."""
    suffix = SUFFIXES["audited"]
    if not audited.endswith(suffix):
        raise ValueError(f"the audited table's name must end in {suffix}")
    return audited[: -len(suffix)] + SUFFIXES["swaps"]
