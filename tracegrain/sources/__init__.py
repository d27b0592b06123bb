"""Readers, writers and derived test inputs."""
