"""Everyday licence statements, SPDX expressions and what negates them."""

import pytest

from leadspark.llm import licenses


@pytest.mark.parametrize(("text", "labels"), [
    ("License: MIT", {"mit"}), ('license = "MIT"', {"mit"}), ('"license": "Apache-2.0"', {"apache-2"}), ("licence: GPLv3", {"gpl-3"}), ("License: GPL-2.0-or-later", {"gpl-2"}), ("License: BSD", {"bsd"}), ("license: BSD-3-Clause", {"bsd-3"}), ("License: LGPL v2.1", {"lgpl-2.1"}), ("license: MPL-2.0", {"mpl-2"}), ("License: CC0-1.0", {"cc0"}),
    ("licensed under MIT", {"mit"}), ("MIT licensed", {"mit"}), ("an MIT-licensed\nlibrary", {"mit"}), ("released under MIT and Apache 2.0", {"mit"}), ("Licensed under Apache 2.0", {"apache-2"}), ("licensed under the Apache License, version 2", {"apache-2"}), ("Apache 2.0 licensed", {"apache-2"}), ("released under the BSD", {"bsd"}),
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", {"apache-2", "mit"}), ("SPDX-License-Identifier: (MIT AND BSD-3-Clause)", {"mit", "bsd-3"}), ("SPDX-License-Identifier: MIT\nsome text or ISC", {"mit"}),
    ("GNU GPL version 2", {"gpl-2"}), ("the LGPL version 2.1 license", {"lgpl-2.1"}), ("the GPL, version 3", {"gpl-3"}), ("License :: OSI Approved :: MIT License", {"mit"}),
    ("no longer released under the MIT License", set()), ("neither licensed under the GPL", set()), ("nicht unter der MIT License", set()), ("MIT press, mit uns, limit", set()), ("published with MIT Press", set()), ("license: unknown", set()), ("a permit: mit", set()),
])
def test_statements(text, labels):
    assert {d[4] for d in licenses.detect(text)} == labels


def test_the_gate_loses_none_of_the_new_rules():
    texts = ["License:\n MIT", "mit-licensed", "SPDX-License-Identifier:  Apache-2.0  OR  MIT", "GPL  version   2", "licensed\nunder\nthe\nmit", "License ::  OSI Approved :: MIT   License", "released under the\tISC"]
    for t in texts:
        assert licenses.detect(t) == licenses.detect(t, gated=False)


def test_signatures_are_written_by_hand():
    assert len(licenses.SIGNATURES) > 100 and len({s[4] for s in licenses.SIGNATURES}) == len(licenses.SIGNATURES)
