"""Files of the stream query: no more of them on larger tables, and repeated claim ids stay in one file."""

import pytest

from caregap.plans import catalog_sinks


@pytest.mark.parametrize("last", [0, 1_000, 99_999, 600_000, 36_000_000])
@pytest.mark.parametrize("first", [0, 7, 1_000_049])
def test_files_are_bounded(first, last):
    size = catalog_sinks._file_rows(first, first + last)
    assert size >= catalog_sinks.FILE_ROWS and size % 50 == 0
    assert (first + last) // size - first // size + 1 <= catalog_sinks.FILES + 1
