"""Readers and writers: scene sets, catalogs, run folders, images, reports."""
