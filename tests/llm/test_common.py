import re
from pathlib import Path

from hashwood.llm.common import give_back, trim


def _anonymous_mb(pid: int) -> float:
    return int(re.search(r"\nAnonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def test_drivers_freed_native_memory_is_returned(spark):
    """A block that stays in use keeps freed ones below it with the process, until they are asked back."""
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    give_back(spark)
    deflaters = [jvm.java.util.zip.Deflater() for _ in range(600)]
    held = _anonymous_mb(pid)
    for d in deflaters[:-1]:
        d.end()
    freed = held - _anonymous_mb(pid)
    give_back(spark)
    returned = held - _anonymous_mb(pid)
    deflaters[-1].end()
    assert trim(spark) and returned > 50 and returned > freed + 20
