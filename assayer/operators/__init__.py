"""DataFrame operators; every scope key is ``(repo, commit_sha)``."""

KEY = ["repo", "commit_sha"]
