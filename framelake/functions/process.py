"""What a process uses, from /proc: the samples of a benchmark."""

from __future__ import annotations

import os


def memory_mb(pid: int | str = "self") -> float:
    """Resident memory of a process."""
    with open(f"/proc/{pid}/status", encoding="ascii", errors="replace") as f:
        for line in f:
            if line.startswith("VmRSS:"):
                return int(line.split()[1]) / 1024
    return 0.0


def cpu_ticks(pid: int | str = "self") -> tuple[int, int]:
    """(user, system) clock ticks of a process. Its name may hold spaces, so the
    fields count from the closing bracket."""
    with open(f"/proc/{pid}/stat", encoding="ascii", errors="replace") as f:
        fields = f.read().rpartition(")")[2].split()
    return int(fields[11]), int(fields[12])


def system_ticks() -> int:
    """All clock ticks of the machine so far."""
    with open("/proc/stat", encoding="ascii") as f:
        return sum(map(int, f.readline().split()[1:]))


def cpu_percent(before: tuple[tuple[int, int], int], after: tuple[tuple[int, int], int]) -> float:
    """Percent of one core between two samples of (cpu_ticks, system_ticks); 0 where
    the machine's clock did not move."""
    (p0, s0), (p1, s1) = before, after
    return (sum(p1) - sum(p0)) / (s1 - s0) * 100 * (os.cpu_count() or 1) if s1 > s0 else 0.0
