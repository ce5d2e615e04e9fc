from conftest_llm import clashing, corpus, odd  # noqa: F401
