"""Workflows over many queries at once: state, components, runners, prompts and providers."""
