"""Index building, document sets, snippets, change plans, compaction."""
