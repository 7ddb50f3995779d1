"""End-to-end jobs: categorize and explore."""
