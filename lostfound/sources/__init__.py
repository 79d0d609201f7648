"""Readers and writers of the registry inputs."""
