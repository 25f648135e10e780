"""Small constant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tunetable.sources.schemas import PROBLEMS

# The example prompts offered to users, and the prompts of the sample review problems.
EXAMPLE_PROMPTS = (
    (
        "Fibonacci (DP)",
        "Write a Python function to compute the nth Fibonacci number using dynamic programming "
        "with O(1) space complexity. Include type hints and a full docstring.",
    ),
    (
        "Binary Search Tree",
        "Implement a Python class for a Binary Search Tree with insert, search, and in-order "
        "traversal methods. Include proper type hints and docstrings.",
    ),
    (
        "REST API client",
        "Write a Python class that wraps the requests library to build a robust REST API client "
        "with retry logic, timeout handling, and JSON response parsing.",
    ),
    (
        "Async web scraper",
        "Create an async Python function using aiohttp to scrape multiple URLs concurrently and "
        "return a dictionary mapping URL to page title.",
    ),
    (
        "Matrix operations",
        "Implement matrix multiplication in pure Python (no numpy) with proper validation, type "
        "hints, and O(n³) algorithm documentation.",
    ),
)
REVIEW_PROMPTS = (
    "Write a Python function to compute the Fibonacci sequence up to n.",
    "Create a function to check if a string is a palindrome.",
    "Write a function that returns the prime factors of a given number.",
)


SAMPLE_ANSWERS = (
    "def fib(n: int) -> list[int]:\n    a, b, out = 0, 1, []\n    for _ in range(n):\n"
    "        out.append(a)\n        a, b = b, a + b\n    return out",
    "def is_palindrome(text: str) -> bool:\n    return text == text[::-1]",
    "def prime_factors(n: int) -> list[int]:\n    d = 2\n    while d * d <= n:\n"
    "        if n % d == 0:\n            return [d, *prime_factors(n // d)]\n        d += 1\n"
    "    return [n] if n > 1 else []",
)


def example_prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXAMPLE_PROMPTS), "label string, prompt string")


def review_problems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(REVIEW_PROMPTS, SAMPLE_ANSWERS)), PROBLEMS)
