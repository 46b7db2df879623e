import random

import pyarrow as pa
import pytest

from veilscan.sources.history import COMMIT_MARKER
from veilscan.sources.log_ranges import _RangeParser


@pytest.mark.parametrize("seed", range(6))
def test_lines_between_commit_headers_are_not_parsed_for_the_state(seed, monkeypatch):
    rng = random.Random(seed)
    lines = [rng.choice([
        f"{COMMIT_MARKER}\0{i:04x}\0A\0d\0", f"{COMMIT_MARKER}\0short", f"diff --git a/f{i} b/f{i}", f"+++ b/f{i}",
        f"@@ -1 +{i} @@", "@@ broken", "+row", "+row", "-gone", "+one\r+two", " kept", f"+{COMMIT_MARKER}\0x", "+crlf\r",
    ]) for i in range(300)]
    whole, short = _RangeParser(COMMIT_MARKER), _RangeParser(COMMIT_MARKER)
    fed, feed = [], _RangeParser.feed
    monkeypatch.setattr(_RangeParser, "feed", lambda self, values: (fed.append(len(values)), feed(self, values))[1])
    at, wanted, given = 0, [], []
    while at < len(lines):
        end = at + rng.randint(1, 60)
        values = pa.array(lines[at:end])
        at = end
        for rows, parser, parse in ((wanted, whole, whole.feed), (given, short, short.feed_open)):
            rows += [r for r in parse(values).to_pylist() if not r["known"]]
        assert whole.summary == short.summary
    assert wanted == given
    assert sum(fed) < 2 * len(lines) - 100
