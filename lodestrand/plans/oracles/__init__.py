"""SQL written apart from the library's own plans, to check them in another engine."""
