"""The whole search on a few small discs."""

import pytest

from candex.operators.pictures import find_pictures

ENTRIES = "image_id STRING, view INT, entry_id INT, parent_id INT, pos INT, name STRING, is_dir BOOLEAN, size BIGINT, readable BOOLEAN"
ATTEMPTS = "image_id STRING, view INT, stage STRING, attempt INT, mean DOUBLE, stddev DOUBLE, bad INT, total INT, source STRING, saw_video BOOLEAN"


def disc(image, view, files):
    """Entries of a disc from ``path: (size, readable)``; folders are made as needed."""
    rows, ids = [(image, view, 0, None, 0, "", True, None, True)], {"": 0}

    def add(path, size, readable, is_dir):
        up, _, name = path.rpartition("/")
        if up not in ids:
            add(up, None, True, True)
        ids[path] = len(rows)
        rows.append((image, view, ids[path], ids[up], len(rows), name, is_dir, size, readable))

    for path, (size, readable) in files.items():
        add(path, size, readable, False)
    return rows


def frame(image, view, stage, attempt, mean, sd, bad=0, video=True):
    return (image, view, stage, attempt, mean, sd, bad, 100, f"{stage} {attempt}", video)


@pytest.fixture(scope="module")
def found(spark):
    small, large = (100, True), (900, True)
    entries = (
        # Artwork beats covers; the size in the name beats the bytes, an unreadable file is passed over.
        disc("art", 1, {"cover.jpg": small, "bdmv/Meta/DL/a_640x360.jpg": small, "bdmv/Meta/DL/b_1920x1080.jpg": (5, False),
                        "bdmv/Meta/DL/c_416x240.jpg": large, "bdmv/Meta/TN/t_9999x9999.png": large})
        + disc("thumbs", 1, {"BDMV/META/DL/x.xml": small, "BDMV/META/DL/empty.jpg": (0, True), "BDMV/META/TN/t.gif": small})
        # The large jacket is broken, the medium one does not fit beside it, the small one does.
        + disc("jacket", 1, {"JACKET_P/J00___5S.MP2": (200 << 10, True), "JACKET_P/J00___5M.MP2": (3 << 20, True),
                             "JACKET_P/J00___5L.MP2": (2 << 20, False), "poster.png": small})
        + disc("cover", 1, {"thumb.jpg": small, "Poster.JPG": small, "folder2.jpg": small, "sub/folder.jpg": small})
        + disc("dvd", 1, {"VIDEO_TS/VTS_01_1.VOB": large})
        + disc("dark", 1, {"VIDEO_TS/VTS_01_1.VOB": large})
        + disc("second", 1, {"readme.txt": small}) + disc("second", 2, {"Cover.bmp": small})
        + disc("searched", 1, {"a.txt": small}) + disc("searched", 2, {"JACKET_P/J00___5L.MP2": small, "front.jpg": small})
        + disc("nothing", 1, {"a.txt": small})
    )
    attempts = [
        frame("dvd", 1, "dvd", 1, 20.0, 60.0), frame("dvd", 1, "dvd", 2, 90.0, 40.0, bad=11), frame("dvd", 1, "dvd", 3, 80.0, 12.0),
        frame("dvd", 1, "dvd", 4, 90.0, 40.0), frame("dvd", 1, "bluray", 1, 90.0, 40.0),
        frame("dark", 1, "dvd", 1, 17.0, 2.0), frame("dark", 1, "dvd", 2, 18.0, 7.0), frame("dark", 1, "dvd", 3, 19.0, 7.0),
        frame("searched", 1, "dvd", 1, 90.0, 40.0, bad=50), frame("searched", 2, "dvd", 1, 90.0, 40.0),
        frame("cover", 1, "dvd", 1, 90.0, 40.0),
    ]
    out = find_pictures(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(attempts, ATTEMPTS))
    return {r["image_id"]: (r["view"], r["stage"], r["path"]) for r in out.collect()}


def test_stages_and_views(found):
    assert found == {
        "art": (1, 1, "BDMV/META/DL/a_640x360.jpg"),
        "thumbs": (1, 2, "BDMV/META/TN/t.gif"),
        "jacket": (1, 3, "JACKET_P/J00___5S.MP2"),
        "cover": (1, 4, "Poster.JPG"),
        "dvd": (1, 5, "dvd 3"),
        "dark": (1, 5, "dvd 2"),
        "second": (2, 4, "Cover.bmp"),
        "searched": (2, 4, "front.jpg"),
    }
