"""Test modules are collected by their base name: two of one name would keep
each other from running."""

import os
from collections import Counter

from conftest import ROOT


def test_test_modules_have_names_of_their_own():
    names = Counter(f for _, _, files in os.walk(os.path.join(ROOT, "tests")) for f in files if f.startswith("test_") and f.endswith(".py"))
    assert names and max(names.values()) == 1, names.most_common(3)
