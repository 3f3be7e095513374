"""How an application's repositories are indexed, and the plans that do it."""
