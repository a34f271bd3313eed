from conftest_llm import empty, odd, odd_rows  # noqa: F401
