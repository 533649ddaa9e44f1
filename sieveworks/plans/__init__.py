"""Whole pipelines, put together from the operators. Nothing runs until a sink or an action asks for it."""
