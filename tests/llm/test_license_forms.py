"""Ways to write a license's version, and names after the word license."""

import pytest

from ledgerloom.llm import licenses

FORMS = {
    "gpl v3": "gpl-3", "GPL v 3": "gpl-3", "GPLv3": "gpl-3", "GPL version 3 or later": "gpl-3", "GPL 3.0": "gpl-3", "gpl-v2": "gpl-2",
    "LGPLv2.1": "lgpl-2.1", "lgpl v2.1": "lgpl-2.1", "LGPLv3": "lgpl-3", "AGPLv3": "agpl-3", "mpl v2.0": "mpl-2.0", "MPL 2.0": "mpl-2.0",
    "License: MIT": "mit", 'license = "MIT"': "mit", "License: GPL": "gpl", "Apache License v2.0": "apache-2.0", "Apache License, Version 2.0": "apache-2.0",
    "GNU General Public License v3": "gpl-3", "Mozilla Public License v2.0": "mpl-2.0", "Eclipse Public License v2.0": "epl-2.0", "Boost Software License v1.0": "bsl-1.0",
}


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, f"Some words, {form}, and more") for i, form in enumerate(FORMS)]
    found = licenses.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {form: next(r.labels for r in found if r.doc_id == i).split(",") for i, form in enumerate(FORMS)}


@pytest.mark.parametrize("form", FORMS)
def test_forms(labels, form):
    assert FORMS[form] in labels[form]
