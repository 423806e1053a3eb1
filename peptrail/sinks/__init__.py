"""Exports and manifests of finished stages."""
