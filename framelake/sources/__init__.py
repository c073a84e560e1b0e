"""Readers and writers: manifests, label files, image folders, exports."""
