"""What a task that parses pages holds."""

import pyarrow as pa

from agora.sources import html


def test_batches_of_long_pages_are_small():
    text = "<p>" + "x" * 200_000
    given = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([text] * 40)], ["page_id", "html"])
    sizes = [b.num_rows for b in html.batches(iter([given]))]
    assert sum(sizes) == 40 and max(sizes) <= 6
